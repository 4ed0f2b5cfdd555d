"""Listings in parts: against running lengths in Python, in many partitions, and in the results of wide claims."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import listings
from claimweave.operators.listings import listing_parts
from claimweave.plans import features, validation
from claimweave.plans.features import Limits


def expected_parts(items, most, separator):
    """(n_items, listing) by (key, part) from (key, item) rows."""
    found, ran = {}, {}
    for key, item in sorted(items):
        part = ran.get(key, 0) // most
        ran[key] = ran.get(key, 0) + len(item) + len(separator)
        found.setdefault((key, part), []).append(item)
    return found


@pytest.mark.parametrize("most", [1, 37, 10_000])
def test_same_as_running_lengths(spark, most):
    rng = random.Random(most)
    items = [(rng.choice(["hot", "hot", "hot", "a", "b"]), "é" * rng.randrange(12) + str(rng.randrange(40))) for _ in range(3000)]
    frame = spark.createDataFrame(items, "k string, item string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = listing_parts(frame, ["k"], ["item"], "item", most, " | ").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.k, r.part): r.listing for r in found} == expected_parts(items, most, " | ")
    assert all(r.n_items == len(r.listing) for r in found)
    assert listing_parts(frame.limit(0), ["k"], ["item"], "item", most, " | ").collect() == []


@pytest.fixture(scope="module")
def wide(spark, make_claims, make_extractions):
    """One claim with many documents and names, one with purchases alone, and a small one."""
    rows = [("wide", f"wide-{i:03}", "DIAGNOSTIC_REPORT", {"patient_name": f"Name {i:03}"}) for i in range(60)]
    rows += [("wide", f"wide-p{i}", "PRESCRIPTION", {"patient_name": "Ann", "medicines": {"medicine_name": [f"Drug {i} {j:03}" for j in range(20)]}}) for i in range(3)]
    rows += [("bought", f"bought-{i}", "PHARMACY_INVOICE", {"medicine_items": {"medicine_name": [f"Pill {i} {j:03}" for j in range(50)]}}) for i in range(4)]
    rows += [("small", "small-1", "PRESCRIPTION", {"patient_name": "Ann", "medicines": {"medicine_name": ["Drug"]}})]
    return make_claims([(c, "Ann", "1") for c in ("wide", "bought", "small")]), make_extractions(rows)


def test_long_listings_show_their_first_part(wide):
    claims, extractions = wide
    limits = Limits(listing_chars=300)
    fields = features.stored_fields(extractions)
    plain = {r.claim_id: r for r in features.document_features(claims, fields).collect()}
    short = {r.claim_id: r for r in features.document_features(claims, fields, limits).collect()}
    assert short["small"] == plain["small"]
    names = plain["wide"].extracted_names.split(" | ")
    first = expected_parts([("k", n) for n in names], 300, " | ")
    assert short["wide"].extracted_names == " | ".join(first["k", 0]) + f" | and {max(p for _, p in first)} more parts"
    for claim, side in (("wide", "prescribed_items"), ("bought", "purchased_items"), ("bought", "unmatched_items")):
        whole = [("k", n) for n in plain[claim][side]]
        assert short[claim][side] == expected_parts(whole, 300, " | ")["k", 0] and len(whole) > len(short[claim][side])
    for name in ("name_mismatches", "prescribed_count", "purchased_count", "unmatched_count", "document_count"):
        assert all(short[c][name] == plain[c][name] for c in plain)
    whole = features.claim_listings(fields, most=300)
    listed = [(r.kind, r.part, r.listing) for r in whole.filter("claim_id = 'wide'").orderBy("kind", "part").collect()]
    assert [n for kind, _, part in listed if kind == "NAME" for n in part] == names
    assert [n for kind, _, part in listed if kind == "PRESCRIBED" for n in part] == plain["wide"].prescribed_items
    assert {r.claim_id for r in features.wide_claims(fields, limits).collect()} == {"wide", "bought"}


def test_no_way_gathers_a_wide_claim(wide):
    """What is collected of a wide claim is grouped by part."""
    claims, extractions = wide
    fields = features.stored_fields(extractions)
    plan = validation.result_rows(
        validation.judged_claims(features.document_features(claims, fields, Limits(listing_chars=300)).withColumn("missing_types", F.array().cast("array<string>")))
    )._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line]
    assert gathered and all("part#" in line.split("]")[0] or "_documents" in line for line in gathered), gathered


@pytest.mark.parametrize("most", [1, 37, 10_000])
def test_long_and_short_listings_side_by_side(spark, monkeypatch, most):
    """What is longer than a task may gather is dealt by ranges, the rest beside it is not; the same parts as ever."""
    monkeypatch.setattr(listings, "LONG_LISTING", 200)
    rng = random.Random(most)
    items = [("long", f"{'é' * rng.randrange(9)}{rng.randrange(60)}") for _ in range(900)] + [("short", "b"), ("short", "a"), ("short", ""), ("one", "x")]
    frame = spark.createDataFrame(items, "k string, item string").repartition(5)
    found = listing_parts(frame, ["k"], ["item"], "item", most, " | ").collect()
    assert {(r.k, r.part): r.listing for r in found} == expected_parts(items, most, " | ")


def test_short_listings_are_moved_once(spark):
    frame = spark.createDataFrame([(str(n % 50), str(n)) for n in range(500)], "k string, item string")
    plan = listing_parts(frame, ["k"], ["item"], "item", 10, " | ")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange ") == 1

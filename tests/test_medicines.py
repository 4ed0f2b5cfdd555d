import random
import time

import pytest
from pyspark.sql import functions as F

from claimweave.operators import medicines
from claimweave.operators.medicines import distinct_medicines, unmatched_by_join, unmatched_in_row, unmatched_medicines


def brute_force(rows):
    """Every purchased spelling of a claim against every prescribed one."""
    def key(text):
        return "".join(c for c in text.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    unmatched = set()
    for claim, side, name in rows:
        if side == "PURCHASED" and not any(
            c == claim and s == "PRESCRIBED" and (key(name) in key(n) or key(n) in key(name)) for c, s, n in rows
        ):
            unmatched.add((claim, name))
    return unmatched


def made_up_rows():
    rng = random.Random(7)
    rows = []
    for claim in range(40):
        for side in ("PRESCRIBED", "PURCHASED"):
            for _ in range(rng.choice([0, 1, 3, 12])):
                length = rng.choice([0, 1, 2, 3, 8, 40, 90])
                rows.append((f"c{claim}", side, "".join(rng.choice("aB1 -") for _ in range(length))))
    long_name = "x" * 50 + "long medicine name" * 5
    rows += [("long", "PRESCRIBED", long_name), ("long", "PURCHASED", long_name[20:110]), ("long", "PURCHASED", long_name + "!"), ("long", "PURCHASED", "y" + long_name[:60])]
    return rows


def test_join_form_equals_brute_force(spark):
    rows = made_up_rows()
    frame = spark.createDataFrame(rows, "claim_id string, side string, medicine string")
    found = {tuple(r) for r in unmatched_by_join(distinct_medicines(frame)).select("claim_id", "medicine").collect()}
    assert found == brute_force(rows) and found


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_names_with_common_grams(spark, monkeypatch, most):
    """Few grams for many names, so the rarest one is common: pairs within a bound, substrings beyond it."""
    monkeypatch.setattr(medicines, "MOST_HOLDERS", most)
    rng = random.Random(11)
    rows = [("c", rng.choice(["PRESCRIBED", "PURCHASED"]), "".join(rng.choice("ab") for _ in range(rng.randrange(13)))) for _ in range(400)]
    rows += [("d", "PURCHASED", "alone"), ("e", "PRESCRIBED", ""), ("e", "PURCHASED", "x"), ("f", "PRESCRIBED", "x"), ("f", "PURCHASED", "")]
    frame = distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string"))
    found = {tuple(r) for r in unmatched_by_join(frame).select("claim_id", "medicine").collect()}
    assert found == brute_force(rows) and ("d", "alone") in found


def test_candidates_grow_with_the_names(spark):
    """Two thousand names of one make on either side: the rarest gram of each is in a few others, not in all."""
    rows = [("c", side, f"Common prefix {i * step:07d} forte") for side, step in (("PRESCRIBED", 2), ("PURCHASED", 1)) for i in range(2000)]
    frame = distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string"))
    assert unmatched_by_join(frame).count() == 1000


def test_row_form_equals_brute_force(spark):
    rows = made_up_rows()
    frame = spark.createDataFrame(rows, "claim_id string, side string, medicine string")
    lists = frame.groupBy("claim_id").agg(
        F.collect_set(F.when(F.col("side") == "PRESCRIBED", F.col("medicine"))).alias("a"),
        F.collect_set(F.when(F.col("side") == "PURCHASED", F.col("medicine"))).alias("b"),
    )
    found = lists.select("claim_id", F.explode(unmatched_in_row(F.col("b"), F.col("a"))).alias("medicine"))
    assert {tuple(r) for r in found.collect()} == brute_force(rows)


def test_sizes_decide_the_way_but_not_the_result(spark):
    rows = made_up_rows()
    names = distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string"))
    for limits in ({}, {"max_pairs": 5}, {"max_pairs": 0}, {"max_names": 2}):
        assert {tuple(r) for r in unmatched_medicines(names, **limits).collect()} == brute_force(rows), limits


def test_many_names_in_one_row(spark):
    """Keys are made once per name: four million comparisons a claim take seconds, not minutes."""
    names = spark.range(4).select(
        F.col("id").cast("string").alias("claim_id"),
        F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("Medicine no. "), (i * 2).cast("string"), F.lit(" forte"))).alias("a"),
        F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("MEDICINE-NO "), i.cast("string"), F.lit(" FORTE"))).alias("b"),
    )
    started = time.time()
    found = names.select("claim_id", F.size(unmatched_in_row(F.col("b"), F.col("a"))).alias("n")).collect()
    assert {r.n for r in found} == {1000} and time.time() - started < 15


def test_one_very_long_name(spark):
    """Substrings of a long name travel as digests: rows stay short."""
    long = "".join(f"part{i}" for i in range(12_000))
    rows = [("c", "PURCHASED", long), ("c", "PURCHASED", "absent")] + [("c", "PRESCRIBED", f"medicine{i:04}" + "x" * (i % 5)) for i in range(1000)]
    found = unmatched_by_join(distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string")))
    assert {r.medicine[:10] for r in found.collect()} == {"absent", long[:10]}
    rows.append(("c", "PRESCRIBED", long[70_000:70_040]))
    found = unmatched_by_join(distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string")))
    assert [r.medicine for r in found.collect()] == ["absent"]


def test_names_that_are_settled_are_not_looked_up(spark, monkeypatch):
    """Equal names are out before any grams are made, names that hold a prescribed one before the last look."""
    rows = [(f"c{n}", side, f"pill {n}") for n in range(40) for side in ("PRESCRIBED", "PURCHASED")]
    rows += [("d", "PRESCRIBED", "aspirin"), ("d", "PURCHASED", "aspirin 500"), ("d", "PURCHASED", "spiri"), ("d", "PURCHASED", "other")]
    names = medicines.distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string"))
    given, plain = [], medicines._containments
    monkeypatch.setattr(medicines, "_containments", lambda inner, outer: (given.append((inner.count(), outer.count())), plain(inner, outer))[1])
    assert [(r.claim_id, r.medicine) for r in medicines.unmatched_by_join(names).collect()] == [("d", "other")]
    assert given == [(1, 3), (2, 41)]


def test_names_without_a_claim_or_a_key_stay(spark):
    rows = [(None, "PURCHASED", "pill"), (None, "PRESCRIBED", "pill"), ("a", "PURCHASED", None), ("a", "PRESCRIBED", "pill")]
    names = medicines.distinct_medicines(spark.createDataFrame(rows, "claim_id string, side string, medicine string"))
    found = [(r.claim_id, r.medicine) for r in medicines.unmatched_by_join(names).collect()]
    assert sorted(found, key=str) == [("a", None), (None, "pill")]


def test_tables_of_names_are_not_sent_to_the_driver(spark, monkeypatch):
    """A file of repeated names is a hundredth of what it is in memory, so its size says nothing about a broadcast."""
    names = distinct_medicines(spark.createDataFrame(made_up_rows(), "claim_id string, side string, medicine string"))
    plans, plain = [], medicines.materialize

    def kept(rows, *purpose):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return plain(rows, *purpose)

    monkeypatch.setattr(medicines, "materialize", kept)
    monkeypatch.setattr(medicines, "MOST_HOLDERS", 0)
    found = medicines.unmatched_by_join(plain(names, "names"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in plan for plan in plans) and sum(plan.count("SortMergeJoin") for plan in plans) >= 10
    assert {(r.claim_id, r.medicine) for r in found.collect()} == brute_force(made_up_rows())

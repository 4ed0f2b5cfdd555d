import re

import pytest

from claimweave.operators import latest, medicines
from claimweave.plans import features, validation


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, make_claims, make_documents, make_extractions):
    """Small tables read from Parquet, as in a running system."""
    root = tmp_path_factory.mktemp("stored")
    frames = {
        "claims": make_claims([("a", "Ann", "1")]),
        "documents": make_documents([("a", "CLAIM_FORM", "EXTRACTED")]),
        "extractions": make_extractions([("a", "d", "CLAIM_FORM", {"patient_name": "Ann"})]),
    }
    read = {}
    for name, frame in frames.items():
        frame.write.parquet(str(root / name))
        read[name] = spark.read.parquet(str(root / name))
    return read


def plan_of(frame):
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def full_plan(spark, frame):
    """Plan with untruncated scan details."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_latest_is_limited_before_the_shuffle(spark, stored):
    plan = plan_of(latest.latest_extractions(stored["extractions"]))
    limits, exchange = [m.start() for m in re.finditer("WindowGroupLimit", plan)], plan.index("Exchange")
    assert len(limits) == 2 and limits[0] < exchange < limits[1]
    assert plan.count("Exchange") == 1


def test_payloads_are_read_before_the_shuffle(spark, stored):
    plan = full_plan(spark, features.latest_fields(stored["extractions"]))
    assert "EqualTo(extraction_status,EXTRACTED)" in plan
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "extracted_response" in schema and "extraction_result" not in schema and "extraction_scoring" not in schema
    exchanged = re.search(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan).group(1)
    assert "extracted_response" not in exchanged and "patient_name" in exchanged


def test_financial_check_reads_only_amounts(spark, stored):
    plan = full_plan(spark, validation.validate_financial(stored["claims"], stored["extractions"]))
    assert "collect_list" not in plan and "medicine_name" not in plan


def test_validation_has_one_shuffle_per_table(spark, stored):
    fields = features.stored_fields(stored["extractions"])
    rows = features.claim_features(stored["claims"], stored["documents"], fields)
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(validation.result_rows(validation.judged_claims(rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert len(re.findall(r"Exchange hashpartitioning\(claim_id", plan)) == 3
    assert len(re.findall("Exchange", plan)) == 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_required_documents_are_combined_before_the_shuffle(spark, stored):
    plan = plan_of(features.present_types(stored["documents"]))
    assert "partial_max" in plan and plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_claims_are_gathered_after_rows_are_dealt(spark, stored):
    """Lists made on the map side have one entry each, are longer than the rows, and cost each task a sort of all its rows."""
    fields = features.stored_fields(stored["extractions"])
    names = spark.createDataFrame([("a", "PURCHASED", "Aspirin", "ASPIRIN")], "claim_id string, side string, medicine string, key string")
    for rows in (features.document_features(stored["claims"], fields), medicines.unmatched_medicines(names)):
        plan = plan_of(rows)
        assert re.search(r"ObjectHashAggregate.*\n.*ObjectHashAggregate.*\n(?:.*Project.*\n)?.*Exchange hashpartitioning\(claim_id", plan)


def test_versions_are_dealt_once(spark, make_claims, make_extractions):
    """The newest version of a document is chosen where its claim is gathered; older versions and wide claims change nothing."""
    rows = [(f"c{n % 7}", f"d{n % 21}", kind, {"patient_name": f"Name {n % 3}", "medicines": {"medicine_name": [f"Drug {n}"]}}, status, 1 + n % 5)
            for n, (kind, status) in enumerate([("PRESCRIPTION", "EXTRACTED"), ("CLAIM_FORM", "EXTRACTED"), ("PRESCRIPTION", "FAILED")] * 40)]
    claims, extractions = make_claims([(f"c{n}", "Name 1", "1") for n in range(8)]), make_extractions(rows)
    fields, versions = features.stored_fields(extractions), features.stored_versions(extractions)
    assert versions.count() == 80 > fields.count()
    plain = sorted(map(str, features.document_features(claims, fields).collect()))
    for limits in (features.Limits(), features.Limits(pairs=0), features.Limits(hot_rows=3), features.Limits(listing_chars=20)):
        wide = sorted(map(str, features.document_features(claims, fields, limits).collect()))
        assert sorted(map(str, features.document_features(claims, versions, limits).collect())) == wide and (limits.listing_chars == 20 or wide == plain)
    plan = features.document_features(claims.select("claim_id", "patient_name", "claimed_amount").hint("merge"), versions)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and len(re.findall("Exchange", plan)) == 2 and "hashpartitioning(claim_id, document_id" not in plan.replace("#", "")

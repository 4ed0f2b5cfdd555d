import datetime

import pytest
from pyspark.sql import functions as F

from claimweave import schema
from claimweave.operators import keyed, latest, skew

NOW = datetime.datetime(2024, 5, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_claim_upsert_resets_review_and_keeps_creation(spark):
    old = datetime.datetime(2020, 1, 1)
    claims = spark.createDataFrame(
        [("a", "p", "n", "q", "t", None, "APPROVED", "APPROVED", "ok", old, old), ("b", "p", "n", "q", "t", None, "X", None, None, old, None)],
        schema.PATIENT_CLAIMS,
    )
    headers = spark.createDataFrame(
        [("a", None, "new", "q2", "t2", None), ("c", "p3", "n3", "q3", "t3", None)],
        "claim_id string, patient_id string, patient_name string, policy_number string, claim_type string, claimed_amount decimal(18,2)",
    )
    found = {r.claim_id: r for r in keyed.upsert_claims(claims, headers, now()).collect()}
    assert found["a"].asDict() == dict(
        claim_id="a", patient_id=None, patient_name="new", policy_number="q2", claim_type="t2", claimed_amount=None,
        claim_status="PROCESSING", reviewer_decision=None, reviewer_comments=None, created_at=old, reviewed_at=None,
    )
    assert found["b"].claim_status == "X" and found["b"].created_at == old
    assert (found["c"].claim_status, found["c"].created_at) == ("PROCESSING", NOW)
    again = keyed.upsert_claims(keyed.upsert_claims(claims, headers, now()), headers, now())
    assert again.count() == 3


def test_replace_and_update(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(tuple(r) for r in keyed.replace_by_key(target, new, ["k"]).collect()) == [(1, "z"), (2, "c")]
    updates = spark.createDataFrame([(2, None)], "k int, v string")
    rows = keyed.apply_updates(target, updates, ["k"]).collect()
    assert sorted((r.k, r.v or "") for r in rows) == [(1, "a"), (1, "b"), (2, "")]


def test_latest_filters_before_it_ranks(make_extractions):
    rows = make_extractions([
        ("c", "d", "PRESCRIPTION", {"n": 1}, "EXTRACTED", 1), ("c", "d", "PRESCRIPTION", {"n": 2}, "EXTRACTED", 2),
        ("c", "d", "PRESCRIPTION", {"n": 3}, "FAILED", 3), ("c", "e", "PRESCRIPTION", {"n": 4}, "FAILED", 1),
        ("c", "f", "PRESCRIPTION", {"n": 5}, "EXTRACTED", 1), ("c", "f", "PRESCRIPTION", {"n": 6}, "EXTRACTED", 1),
    ])
    found = latest.latest_extractions(rows).orderBy("document_id").selectExpr("document_id", "variant_get(extracted_response, '$.n', 'int') AS n").collect()
    assert [tuple(r) for r in found] == [("d", 2), ("f", 5)]
    undated = rows.withColumn("extracted_at", F.when(F.col("extraction_id") != "x0000", F.col("extracted_at")))
    found = latest.latest_extractions(undated.filter("document_id = 'd'")).selectExpr("variant_get(extracted_response, '$.n', 'int') AS n").collect()
    assert found[0].n == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_join(spark, how):
    left = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || (id % 50) END AS k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v int")
    plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    assert sorted(map(tuple, skew.hot_join(left, right, ["k"], how, F.col("id"), limit=20).collect()), key=str) == plain
    assert sorted(map(tuple, skew.hot_join(left, right, ["k"], how, F.col("id")).collect()), key=str) == plain


def test_parts_bound_hot_groups(spark):
    rows = spark.range(2000).selectExpr("IF(id < 1500, 'hot', 'k' || id) AS k", "id")
    parts = skew.with_part(rows, ["k"], F.col("id"), limit=100).groupBy("k", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 250
    assert parts.filter("k <> 'hot'").agg(F.max("part")).first()[0] == 0

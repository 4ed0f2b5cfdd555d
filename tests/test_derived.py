"""Derived tables: how they are divided and stored. Their rows are compared with SQL in `test_parity`."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimweave.operators.extraction import split_envelope
from claimweave.session import materialize
from claimweave.sources import derived


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Order tables of one file each; order 7 has more lines than a document has names."""
    root = tmp_path_factory.mktemp("orders")
    keys = spark.range(1, 401)
    tables = {
        "orders": keys.selectExpr(
            "id AS o_orderkey", "id % 20 AS o_custkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus",
            "CAST(id AS double) AS o_totalprice", "DATE'1996-01-01' AS o_orderdate",
        ),
        "customer": spark.range(20).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name"),
        "part": spark.range(1500).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name"),
        "lineitem": keys.selectExpr("id AS l_orderkey", "id % 50 AS l_partkey").unionByName(
            spark.range(1500).selectExpr("CAST(7 AS bigint) AS l_orderkey", "id AS l_partkey")
        ),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(str(root / f"{name}.parquet"))
    few = tmp_path_factory.mktemp("few")
    for name, rows in tables.items():
        (rows.filter("l_orderkey <> 7") if name == "lineitem" else rows).coalesce(1).write.parquet(str(few / f"{name}.parquet"))
    return {"crowded": str(root), "few": str(few)}


def test_documents_are_dealt_over_the_tasks(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = derived.document_rows(spark, sf_dir["few"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_file = [row[1] for row in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(by_file) > 1 and max(by_file) < sum(by_file) / 2


@pytest.mark.parametrize("lines", ["few", "crowded"])
def test_medicine_lists_are_whole_and_bounded(spark, sf_dir, lines):
    lists = derived.medicine_lists(spark, sf_dir[lines]).collect()
    found = {(row["k"], name) for row in lists for name in row["names"]}
    expected = {(k, f"part {k % 50}") for k in range(1, 401) if lines == "crowded" or k != 7}
    if lines == "crowded":
        expected |= {(7, f"part {n}") for n in range(1500)}
    assert found == expected and sum(len(row["names"]) for row in lists) == len(expected)
    assert all(row["names"] == sorted(row["names"]) for row in lists)
    assert len([row for row in lists if row["k"] == 7]) == (2 if lines == "crowded" else 0)


def test_payload_texts_are_not_stored_for_extractions(spark, sf_dir):
    rows = derived.extractions(spark, sf_dir["few"])
    stored = {name for _, path, name in derived._STORED if path == sf_dir["few"]}
    assert "extractions" in stored and "extraction_payloads" not in stored
    again = split_envelope(derived.extraction_payloads(spark, sf_dir["few"])).drop("error_message")
    shown = [F.to_json(F.struct("*")).alias("row")]
    assert rows.columns == again.columns and rows.count() > 2000
    assert sorted(r["row"] for r in rows.select(*shown).collect()) == sorted(r["row"] for r in again.select(*shown).collect())


def test_variants_are_stored_whole(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", """parse_json('{"a": {"b": 1}, "c": "x"}') AS v""")
    (path,) = {file for file in materialize(rows.coalesce(1), "variants").inputFiles()}
    names = [field.name for field in pq.read_schema(path.removeprefix("file://")).field("v").type]
    assert "typed_value" not in names


def test_columns_made_of_others_are_not_stored(spark, sf_dir):
    """Ids, paths and parts of a payload are views of the stored columns; the tables have them all the same."""
    few = sf_dir["few"]
    made = {
        "results": ({"validation_id", "validated_at"}, derived.results(spark, few)),
        "extractions": ({"extracted_response", "extraction_scoring", "extraction_error"}, derived.extractions(spark, few)),
        "document_rows": ({"document_id", "relative_path", "folder", "claim_id"}, derived.document_rows(spark, few)),
    }
    paths = {name: path for (_, sf, name), path in derived._STORED.items() if sf == few}
    for name, (columns, rows) in made.items():
        assert not columns & set(spark.read.parquet(paths[name]).columns) and columns <= set(rows.columns), name
    ids = made["results"][1].select("claim_id", "validation_category", "validation_id")
    assert ids.filter(F.col("validation_id") != F.sha2(F.concat_ws("|", "claim_id", "validation_category"), 256)).isEmpty()
    assert ids.select("validation_id").distinct().count() == ids.count() == 2400


def test_large_tables_have_files_of_bounded_length(spark, monkeypatch):
    """Tasks are shared out by the bytes of files; rows of a few bytes would all go to one."""
    monkeypatch.setattr("claimweave.session.ROWS_PER_FILE", 100)
    rows = materialize(spark.range(1000).coalesce(1), "numbers")
    assert len(rows.inputFiles()) == 10 and rows.count() == 1000

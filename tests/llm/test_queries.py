"""Registered queries: columns, row counts, and their SQL twins on whole tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from claimweave.llm.oracles import ORACLES
from claimweave.llm.queries import QUERIES

COLUMNS = {
    "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "doc_id held_out score predicted",
    "op4": "doc_id n_bytes n_tokens over_limit", "op6": "doc_id fingerprint component_id",
    "op7": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8": "doc_id start n_tokens ids_crc32",
    "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id size text_crc32 law shard slot grown_shard",
}
VECTORS = "vec_id component n deviation whitened explained identity_error"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf, name):
    folder = sf("sf0.001")
    frame = QUERIES[name](spark, folder)
    wanted = (VECTORS if name.startswith("op13") else COLUMNS.get(name.split("_")[0], "doc_id")).split()
    assert set(wanted) <= set(frame.columns)
    if name.split("_")[0] in COLUMNS:
        assert frame.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    folder = sf("sf0.001")
    database = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, folder)
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = [tuple(dict(zip(names, row, strict=True))[c] for c in frame.columns) for row in result.fetchall()]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected, key=str)

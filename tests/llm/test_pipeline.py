"""The pipeline, stage by stage, against brute force on the stage's own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from claimweave.llm import quality_classifier as qc
from claimweave.session import materialize

from .test_decontamination import brute as contained
from .test_mixing import brute as mixed
from .test_simhash import components, fingerprint


def good(spark, docs, folder):
    model = qc.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [r for r in docs.collect() if round(float(model.scores(*qc.passages([(r.text or "").encode()]))[0]), 6) >= qc.ACCEPT]


def one_of_each(spark, docs, folder):
    rows = docs.collect()
    least = components([r.doc_id for r in rows], [fingerprint(r.text) for r in rows])
    return [r for r, own in zip(rows, least, strict=True) if r.doc_id == own]


def clean(spark, docs, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    return [r for r in docs.collect() if not contained([(r.doc_id, r.text)], items)]


def copies(spark, docs, folder):
    rows = {r.doc_id: r for r in docs.collect()}
    drawn = mixed([(r.doc_id, r.text, r.source) for r in rows.values()], pipeline.MIX_WEIGHTS, pipeline.MIX_EPOCHS, pipeline.MIX_SEED)
    return [rows[own] for (own, _, _), n in drawn.items() for _ in range(n)]


def stored(spark, docs, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    out, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, pipeline.END_ID]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


EXPECTED = [good, one_of_each, clean, copies, stored]


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_stages(spark, sf, folder):
    folder = sf(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for (name, stage), expected in zip(pipeline.STAGES, EXPECTED, strict=True):
        out = materialize(stage(spark, docs, folder), "stage")
        assert Counter(map(tuple, out.collect())) == Counter(map(tuple, expected(spark, docs, folder))), name
        assert expected is stored or out.columns == columns
        sizes.append(out.count())
        docs = out
    assert 0 < sizes[2] < sizes[1] < sizes[0] < spark.read.parquet(f"{folder}/documents.parquet").count()
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, make_docs, odd_rows, tmp_path):
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for name, stage in pipeline.STAGES:
            out = materialize(stage(spark, docs, str(tmp_path)), "stage")
            assert name == "token store" or out.columns == docs.columns
            docs = out
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

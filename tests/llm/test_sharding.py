import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimweave.llm import numbering, sharding


def published_jump(key, shards):
    """The function as published, on unsigned 64-bit integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def code(key):
    return int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 33, 1000])
def test_same_as_the_published_function(spark, shards):
    chance = random.Random(shards)
    keys = [0, 1, 2**64 - 1, 2**63, 2**32 - 1, *(chance.getrandbits(64) for _ in range(500))]
    rows = spark.createDataFrame([(str(k), k >> 32, k & 0xFFFFFFFF) for k in keys], "k string, high long, low long")
    found = rows.select("k", sharding.jump(F.struct("high", "low"), shards)["shard"].alias("shard")).collect()
    assert {r.k: r.shard for r in found} == {str(k): published_jump(k, shards) for k in keys}


def test_all_steps_are_made(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_FIRST_STEPS", 1)
    rows = spark.range(200).select("id", sharding.jump(sharding.key_hash(F.col("id")), 24)["shard"].alias("shard")).collect()
    assert all(r.shard == published_jump(code(r.id), 24) for r in rows)


def test_one_more_shard_only_takes(spark):
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id")
    before = sharding.with_shard(docs)
    after = {r.doc_id: r.shard for r in sharding.with_shard(docs, shards=25).collect()}
    rows = before.collect()
    assert all(r.grown_shard == after[r.doc_id] for r in rows)
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {24} and abs(len(moved) - 30_000 / 25) < 5 * (30_000 / 25) ** 0.5
    assert all(abs(n - 1250) < 5 * 1250**0.5 for n in Counter(r.shard for r in rows).values())


def check(found, rows):
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", published_jump(code(i), 24), published_jump(code(i), 25)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == expected
    for shard in {r.shard for r in found}:
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in found if r.shard == shard)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_odd_rows(make_docs, odd_rows):
    check(sharding.shard_report(make_docs(odd_rows)).collect(), odd_rows)
    assert sharding.shard_report(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        sharding.jump(sharding.key_hash(F.lit(1)), 0)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    check(sharding.shard_report(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_written_shards_hold_all_rows(spark, make_docs, odd_rows, tmp_path):
    rows = odd_rows + [(100 + i, f"text {i}") for i in range(300)]
    docs = make_docs(rows).withColumn("shard", F.lit("mine"))
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, published_jump(code(i), 4)) for i, t in rows)


def test_numbers_of_a_group_in_many_partitions(spark, monkeypatch):
    """Two thirds of the rows are alike and in one group; a partition gets no more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9000).selectExpr("CASE WHEN id < 6000 THEN 'hot' ELSE 'g' || id % 7 END AS g", "CASE WHEN id < 6000 THEN 1 ELSE id END AS k")
        stored = []
        plain = numbering.materialize
        monkeypatch.setattr(numbering, "materialize", lambda r, p: stored.append(plain(r, p)) or stored[-1])
        found = numbering.numbered(rows, "g", ["k"]).collect()
        parts = stored[0].groupBy(F.shiftright("_at", 33)).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 3500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, n in [("hot", 6000), *((f"g{i}", sum(x % 7 == i for x in range(6000, 9000))) for i in range(7))]:
        own = sorted((r.position, r.k) for r in found if r.g == g)
        assert [p for p, _ in own] == list(range(n)) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r.n for r in found if r.g == g} == {n}

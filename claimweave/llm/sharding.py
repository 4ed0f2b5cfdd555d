"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no ring table is kept.

A key's 64-bit hash seeds a linear congruential generator whose draws say at which numbers of shards the key moves: 0 = j0 < j1 < j2 ... With n
shards a key is in the last j below n, so one more shard takes 1 / (n + 1) of all keys, into itself only, and every shard has an equal
expected share. About ln(n) + 1 draws are made per key; n always suffice.

Spark's long product fails on overflow, so the generator's state is kept as two halves of 32 bits.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.numbering import numbered
from claimweave.session import materialize

SHARDS = 24
#: Steps that every key is offered; the few keys that need more get all of the rest.
_FIRST_STEPS = 32

# Fixed value: the multiplier of the published function's generator (its increment is 1).
_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_M32, _M16 = 0xFFFFFFFF, 0xFFFF


def key_hash(key: Column) -> Column:
    """struct(high, low): the first 64 bits of the MD5 of the key as text, in two halves; null counts as the empty text."""
    code = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.struct(*(F.conv(F.substring(code, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "high"), (9, "low"))))


def _step(at: Column) -> Column:
    """One draw: `shard` takes over `next`, and the generator says where the key moves to after that."""
    low = at["low"] * (_LOW & _M16) + F.shiftleft((at["low"] * (_LOW >> 16)).bitwiseAND(_M16), 16) + 1
    high = (
        F.shiftright(low, 32) + F.shiftright(at["low"] * (_LOW >> 16), 16)
        + (at["low"] * _HIGH).bitwiseAND(_M32) + (at["high"] * (_LOW - (1 << 32))).bitwiseAND(_M32)
    ).bitwiseAND(_M32)
    draw = F.shiftright(high, 1) + 1
    further = F.floor((at["next"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("long")
    return F.struct(high.alias("high"), low.bitwiseAND(_M32).alias("low"), at["next"].alias("shard"), further.alias("next"))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, next) of longs: the shard of a `key_hash` among `shards`, and the smallest shard number it will move to later."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def walk(first, last, state):
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, lambda at, _: F.when(at["next"] < shards, _step(at)).otherwise(at))

    zero = F.lit(0).cast("long")
    start = F.struct(key["high"].alias("high"), key["low"].alias("low"), zero.alias("shard"), zero.alias("next"))
    found = walk(1, min(shards, _FIRST_STEPS), start)
    if shards > _FIRST_STEPS:
        found = F.transform(F.array(found), lambda at: F.when(at["next"] < shards, walk(_FIRST_STEPS + 1, shards, at)).otherwise(at))[0]
    return F.struct(found["shard"].alias("shard"), found["next"].alias("next"))


def with_shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """`docs` with shard (int) and grown_shard (int): where a row's key lies among `shards` shards, and with one more.

    Rows of equal key are in one shard, null keys too. Columns of these names are replaced.
    """
    plain = docs.drop("shard", "grown_shard")
    placed = plain.withColumn("_jump", jump(key_hash(F.col(key)), shards))
    grown = F.when(F.col("_jump.next") == shards, F.lit(shards)).otherwise(F.col("_jump.shard"))
    return placed.select(*plain.columns, F.col("_jump.shard").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Writes all rows with all columns as Parquet, a folder shard=N for each shard that has rows.

    Rows are dealt by ranges of (shard, hash of key, row), so that a shard of any size becomes several files, each written by one task.
    """
    placed = with_shard(docs, key, shards).drop("grown_shard").withColumn("_tie", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange("shard", F.xxhash64(key), "_tie").sortWithinPartitions("shard").drop("_tie")
    dealt.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the UTF-8 length of the text plus 8; a null text counts as empty, with a crc32 of 0. slot numbers a shard's rows from 0 by doc_id (nulls
    first), crc32 and size; rows alike in all three are in any order. Repeated rows are kept; an empty table gives an empty one;
    other columns are not read. Texts are not moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = with_shard(docs.select("doc_id", "text"), "doc_id", shards)
    rows = sized.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "grown_shard"
    )
    found = numbered(materialize(rows, "sized"), "shard", ["doc_id", "text_crc32", "size"])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("position").alias("slot"), "grown_shard")

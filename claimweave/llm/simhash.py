"""Near-duplicate documents by SimHash fingerprints under a covering family of bit masks.

Masks: every bit of the fingerprint gets a vector of radius + 1 bits, none zero; mask v keeps the bits whose vector has an odd product
with v. The vectors of any `radius` bits leave some v whose product with all of them is even, so two fingerprints
that differ in at most `radius` bits agree on all of mask v: they meet in that table, always, not only with some probability.

Meeting is not being near. A bucket of two is checked as it stands, one of up to `BUCKET` inside its row. In larger ones (texts that vary
one template) no pairs are built: their fingerprints meet again on every fingerprint one bit away. Two fingerprints share such a neighbour, or one
is the other's, exactly if they differ in at most two bits, and a neighbour has at most 65 of them around it.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import slices, text_bytes
from claimweave.llm.components import connected_components
from claimweave.session import materialize

BITS = 64
RADIUS = 2
SHINGLE = 3
_SEED = 42
#: Bytes of a text that are cut into words at a time.
_PIECE_BYTES = 1 << 20
#: Buckets of up to so many fingerprints are compared inside their row, fuller ones by way of their neighbours.
BUCKET = 32


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks as signed 64-bit integers. Bit i has vector i modulo their number, plus one."""
    tables = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, tables + 1):
        mask = sum(1 << i for i in range(BITS) if ((i % tables + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> BITS - 1 else mask)
    return masks


_POWERS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes):
    """The words of a text in lists of about `_PIECE_BYTES`; each starts with the last words of the one before, which a shingle may still need."""
    carried, start = [], 0
    while start < len(text):
        cut = _SPACE.search(text, start + _PIECE_BYTES) if start + _PIECE_BYTES < len(text) else None
        end = cut.start() if cut else len(text)
        words = carried + text[start:end].lower().split()  # bytes lower A-Z only, and split at space and 0x09 to 0x0D
        yield words
        carried, start = words[1 - SHINGLE :], end


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: 1 - SHINGLE]
    digest = xxhash.xxh64_intdigest
    count = len(words) - SHINGLE + 1
    return np.fromiter((digest(line[a:b], _SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, count)


def fingerprint(text: bytes) -> int:
    """Of the lower-cased text's shingles of three words, repeats included; a bit is set if over half of the hashes have it."""
    set_bits, total, words = np.zeros(BITS, np.int64), 0, []
    for words in _pieces(text):
        if len(words) < SHINGLE:
            continue
        hashes = _shingle_hashes(words)
        total += len(hashes)
        for first in range(0, len(hashes), 1 << 16):
            some = hashes[first : first + (1 << 16)]
            set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not total:  # all of its few words are in the last list
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED) if words else 0
    return int(_POWERS[2 * set_bits > total].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed 64-bit integer; null texts are empty."""

    def compute(batches):
        for batch in batches:
            for part, texts in slices(batch):
                prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints)], ["doc_id", "row", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, fp long")


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that give the same components as all pairs within `radius` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("links are exact for a radius of 1 or 2 bits")
    masked = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius)))))
    tables = distinct.select("fp", masked.alias("at")).select("fp", "at.t", "at.key")
    buckets = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = materialize(buckets.where("n > 1"), "buckets")
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    some = tables.join(buckets.where(f"n > 2 AND n <= {BUCKET}").select("t", "key"), ["t", "key"], "left_semi")
    some = some.groupBy("t", "key").agg(F.collect_list("fp").alias("met"))
    partners = F.transform("met", lambda x: F.transform(
        F.filter("met", lambda y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(x.alias("a"), y.alias("b"))
    ))
    pairs = pairs.union(some.select(F.inline(F.flatten(partners))))
    crowded = tables.join(buckets.where(F.col("n") > BUCKET).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < BITS - 1 else -(1 << BITS - 1)) for i in range(BITS)))
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    if radius == 1:  # a fingerprint is linked with its neighbours, but they are not linked with each other
        met = around.join(crowded.select(F.col("fp").alias("hub")), "hub", "left_semi").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    else:
        hubs = around.groupBy("hub").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)  # 65 at most
        met = hubs.select(F.array_min("met").alias("a"), F.explode("met").alias("b"))
    return pairs.union(met.where("a <> b")).distinct()


def components(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id, component) for a table of distinct (fp, least id): the smallest id over all that is reachable, and the smallest fp."""
    parts = connected_components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(parts, "fp")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    moved = named.join(smallest, "component").select("fp", "smallest", "component")
    found = distinct.join(moved, "fp", "left")
    return found.select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("component", "fp").alias("component"))


def _classified(docs: DataFrame, radius: int) -> DataFrame:
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return prints.join(components(distinct, radius), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id among the rows reachable over fingerprints within `radius` bits, the row's own included. Null
    and empty texts have fingerprint zero and link like others; a null doc_id is never a component's id unless the
    component has no other. Repeated ids and rows are kept. An empty table gives an empty one; other columns are not read.
    """
    return _classified(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component one row with the smallest id (null last).

    Where that id stands on several texts of the component, the text with the smallest hash stays; of rows alike in id and text, one. An id
    on texts of several components can stay in each of them.
    """
    found = materialize(_classified(docs, radius).select("doc_id", "row", "component"), "classified")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_stay_id"), F.col("first.row").alias("_stay_row"))
    repeated = found.groupBy("doc_id", "row").count().where("count > 1").toDF("_again_id", "_again_row", "_n")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay_id")) & (F.xxhash64("text") == F.col("_stay_row")), "left_semi")
    if repeated.isEmpty():
        return kept
    again = F.col("doc_id").eqNullSafe(F.col("_again_id")) & (F.xxhash64("text") == F.col("_again_row"))
    once = kept.join(repeated, again, "left_anti")
    return once.union(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))

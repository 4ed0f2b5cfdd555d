"""Benchmark items inside documents: MinHash containment search by size partition, verified on whole shingle sets.

An item is found if at least a share `threshold` of its distinct shingles (five words, letters and digits only, lower case)
stand in the document. Its sketch is its smallest shingle hashes. Items are partitioned by size; with at most u shingles in a
partition, the u - ceil(threshold * u) + 1 smallest hashes are taken: a document that lacked all of them would lack more shingles
than it may. So the search finds every pair, however long the document; sizes only decide how long a sketch must be.

The sketches, not the documents, are sent around. Documents that hold a minimum of an item are candidates; only their shingles are
compared with the item's in full. Everything is built from DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

WORDS = 5
THRESHOLD = 0.8
#: A table with more rows is joined by shuffling; below, it is broadcast (some 32 bytes a row).
BROADCAST_ROWS = 1_000_000
#: The same for shingles with their words, some 100 bytes a row.
BROADCAST_SHINGLES = 125_000

_PARTS = [f"w{i}" for i in range(1, WORDS + 1)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_shingles(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row w1 .. w5 for each shingle of each text, repeats included; a text of fewer words is one shingle, padded with nulls."""
    split = rows.select(*keep, words(F.col(text)).alias("_words"))
    count = F.greatest(F.size("_words") - (WORDS - 1), F.lit(1))
    shifted = [F.slice("_words", i + 1, count).alias(p) for i, p in enumerate(_PARTS)]
    return split.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*_PARTS))


def _hash() -> Column:
    return F.xxhash64(*_PARTS)


def _small(rows: DataFrame, most: int | None = None) -> DataFrame:
    """With a broadcast hint if the rows, which are stored, are few enough."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_ROWS if most is None else most) else rows


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(hash, item) of the smallest hashes of each item; `shingles` has (item, n, hash), n the item's number of them."""
    # The upper bound of the item's size partition: partitions end at powers of two.
    bound = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long")
    most = bound - F.ceil(F.round(bound * threshold, 6)) + 1
    held = shingles.groupBy("item").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("hash")).alias("hashes"))
    return held.select("item", F.explode(F.slice("hashes", F.lit(1), most.cast("int"))).alias("hash")).select("hash", "item")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every pair whose containment reaches `threshold`.

    Null and empty texts have no shingles and are in no pair. A text of fewer than five words is one shingle as a whole, so a
    shorter item is found only where it is the whole document. Null ids are kept as ids. An id that stands on several documents or several
    items' texts is searched with each of them; a pair of ids is reported once, with the largest containment (of equal ones, the item
    of most shingles). Empty tables give an empty result. Of items only item_id and text
    are read, of documents doc_id and text.
    """
    found = _verified(docs, items, threshold).join(_small(_named(items)), "item")
    containment = F.round(F.col("n_shared") / F.col("n_shingles"), 6)
    best = F.max(F.struct(containment.alias("containment"), "n_shingles", "n_shared")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def _named(items: DataFrame) -> DataFrame:
    """(item, item_id): item stands for id and text."""
    return materialize(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id").distinct(), "item-names")


def _verified(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(_key, doc_id, item, n_shingles, n_shared); _key stands for a document's id and text, item for an item's."""
    # An item's shingles are counted together; items are test questions, a row each, of bounded length.
    own = with_shingles(items.select(F.xxhash64("item_id", "text").alias("item"), "text"), ["item"]).distinct()
    counted = own.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(counted, "item").select("item", "n", *_PARTS, _hash().alias("hash"))
    own = materialize(own, "items")
    sketch = materialize(sketches(own, threshold), "sketches")
    found = with_shingles(_keyed(docs), ["_key"]).select("_key", _hash().alias("hash")).join(_small(sketch), "hash").select("_key", "item").distinct()
    found = materialize(found, "candidates")
    keys = _small(materialize(found.select("_key").distinct(), "candidate-keys"))
    shingles = with_shingles(_keyed(docs).join(keys, "_key", "left_semi"), ["_key", "doc_id"])
    same = [F.col(f"d.{p}").eqNullSafe(F.col(f"i.{p}")) for p in _PARTS[1:]]
    # Few items go to the shingles, so that only what is shared moves.
    met = shingles.alias("d").join(_small(own, BROADCAST_SHINGLES).alias("i"), [F.col("d.w1") == F.col("i.w1"), *same])
    shared = met.select("_key", "doc_id", "item", F.col("n").alias("n_shingles"), *(F.col(f"i.{p}") for p in _PARTS)).distinct()
    shared = shared.groupBy("_key", "doc_id", "item", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = shared.where(F.col("n_shared") >= F.round(F.col("n_shingles") * threshold, 6))
    # Only pairs that the search found count; by the sketches' length that is all of them.
    return enough.join(found, ["_key", "item"], "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item is found."""
    hit = materialize(_verified(docs, items, threshold).select(F.col("_key").alias("_hit")).distinct(), "contaminated")
    return docs.join(_small(hit), F.xxhash64("doc_id", "text") == F.col("_hit"), "left_anti")

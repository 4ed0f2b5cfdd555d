"""Helpers shared by the training-data operators: words, fold numbers, bounded samples, Arrow batches."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that pass through one Python loop at a time are cut into slices of at most so many bytes of text.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text, so it is in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, least: int = 0) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch whose texts have at most `most` bytes together, or one text that has more; with those texts.

    A text counts with `least` bytes at least, which bounds the number of short texts in a part.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    start, size = 0, 0
    for row in range(len(texts)):
        length = max(least, texts[row].as_buffer().size if texts[row].is_valid else 0)
        if row > start and size + length > most:
            yield batch.slice(start, row - start), texts.slice(start, row - start).to_pylist()
            start, size = row, 0
        size += length
    if start < len(texts):
        yield batch.slice(start), texts.slice(start).to_pylist()


def bounded_sample(rows: DataFrame, key: list[str], most: int, seed: int) -> DataFrame:
    """At most `most` rows, chosen by a hash of `key`: the same rows for the same table, whatever its partitioning.

    A share slightly above the wanted one is taken by hash first, so that no task sorts or sends more than it must.
    """
    total = rows.count()
    order = F.xxhash64(F.lit(seed), *key)
    if total > most:
        share = min(1.0, (most + 5 * most**0.5 + 20) / total)
        rows = rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return rows.orderBy(order, *key).limit(most)

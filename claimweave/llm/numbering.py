"""Gapless row numbers within groups, without a task that holds a group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize

#: Bits of `monotonically_increasing_id` that count the rows of a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `position` (long, from 0, in `order` within `group`) and `n` (long, rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size spreads over as many partitions as it needs, rows that are
    alike in all of `order` included. What a window then sees is a row per group and partition. `group` must
    not be null; nulls in `order` come first; which of two alike rows is first is open. `rows` is read twice, so it should be a
    stored table; the columns `_tie`, `_at`, `_part`, `_first`, `_rows` and `_before` must be free.
    """
    keys = [group, *order, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    pieces = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")
    )
    # Stored, so that its true size decides how it is joined.
    starts = materialize(starts, "starts")
    found = placed.join(starts, [group, "_part"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("position"), "n")

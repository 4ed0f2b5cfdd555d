"""Long listings as numbered parts of bounded size.

The items of a long listing are dealt by ranges of their order, so a listing of any length spreads over as many tasks as it needs. Running lengths,
counted from where a task's range starts, say which part an item is in; a part is the only thing that is gathered. Listings of bounded length
are moved once, to the task that numbers and gathers them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize

#: Characters of a listing that one task may number by itself.
LONG_LISTING = 1_000_000
#: Bits of `monotonically_increasing_id` that count the rows of a partition.
_ROW_BITS = 33


def with_parts(items: DataFrame, keys: list[str], order: list[str], item: str, most: int, separator: str) -> DataFrame:
    """`items` with `part` (from 0): the number of the part, of about `most` characters, in which an item starts.

    A listing is what has the same `keys` (not null); its items stand in `order`, with `separator` between them. Alike items spread like others.
    `items` is read twice, so it should be a table.
    """
    by = [*keys, *order, "_tie"]
    placed = items.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialize(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ordered-items")
    placed = placed.withColumns({"_piece": F.shiftright("_at", _ROW_BITS), "_size": (F.length(item) + len(separator)).cast("long")})
    # A window sees what one task has of a listing, or one row per task.
    within = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_piece").agg(F.sum("_size").alias("_sum"))
    starts = materialize(sizes.select(*keys, "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")), "listing-starts")
    ran = placed.withColumn("_ran", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(starts, [*keys, "_piece"])
    return ran.select(*items.columns, F.floor((F.col("_start") + F.col("_ran")) / F.lit(most)).cast("int").alias("part"))


def listing_parts(items: DataFrame, keys: list[str], order: list[str], item: str, most: int, separator: str) -> DataFrame:
    """keys, part, n_items and listing (array, in order) of every part; a part has at most `most` characters and one item.

    Lengths are added up first. A listing of up to LONG_LISTING characters is bounded, so one task numbers and gathers it where it lies; longer ones
    are dealt by ranges. `items` is read three times at most, so it should be a table; those without a key are in no listing.
    """
    items = items.dropna(subset=keys)
    size = (F.length(item) + len(separator)).cast("long")
    long = items.groupBy(*keys).agg(F.sum(size).alias("_chars")).filter(F.col("_chars") > LONG_LISTING).select(*keys)
    long = materialize(long, "long-listings")
    if long.isEmpty():
        return _gathered(_in_one_task(items, keys, order, size, most), keys, order, item)
    short = _gathered(_in_one_task(items.join(long, keys, "left_anti"), keys, order, size, most), keys, order, item)
    dealt = with_parts(materialize(items.join(long, keys, "left_semi"), "long-items"), keys, order, item, most, separator)
    return short.unionByName(_gathered(dealt, keys, order, item))


def _in_one_task(items: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ran = items.withColumn("_size", size).withColumn("_ran", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return ran.select(*items.columns, F.floor(F.col("_ran") / F.lit(most)).cast("int").alias("part"))


def _gathered(parted: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    gathered = parted.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("_items"))
    return gathered.select(*keys, "part", F.size("_items").cast("long").alias("n_items"), F.col("_items._item").alias("listing"))

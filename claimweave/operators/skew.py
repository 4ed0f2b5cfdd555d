"""Joins and groupings that stay balanced when one key holds a large share of the rows.

`hot_groups` lists the keys with more than `limit` rows, the `MOST_GROUPS` largest at most; that bound is what makes broadcasting it
safe. Groups beyond it are no larger than any of those, are not cut, and are joined like all others. Counting is a
partial aggregate: no task ever sees a whole group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MOST_GROUPS = 10_000


def hot_groups(rows: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `limit` rows, with the number of parts of at most about `limit` rows each needs."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counted.filter(F.col("_rows") > limit).orderBy(F.desc("_rows"), *keys).limit(MOST_GROUPS)
    return hot.select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))


def with_part(rows: DataFrame, keys: list[str], spread_by: Column, limit: int = HOT_ROWS, part: str = "part") -> DataFrame:
    """Adds a part number that cuts hot groups into parts of about `limit` rows; all other groups are part 0."""
    hot = hot_groups(rows, keys, limit)
    if hot.isEmpty():
        return rows.withColumn(part, F.lit(0))
    return _numbered(rows.join(F.broadcast(hot), keys, "left"), spread_by, part)


def _numbered(rows: DataFrame, spread_by: Column, part: str) -> DataFrame:
    number = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts")), F.lit(0)).cast("int")
    return rows.withColumn(part, number).drop("_parts")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: Column, limit: int = HOT_ROWS) -> DataFrame:
    """Equi-join whose hot left groups are spread over several tasks.

    Counts the keys of `left` first, so `left` should be cheap to read; without hot keys it is a plain join. `right` rows of
    a hot key are repeated once per part: with r right rows per key that adds at most r * |left| / limit rows, so only
    use it where `right` has few rows per key.
    """
    hot = hot_groups(left, keys, limit)
    if hot.isEmpty():
        return left.join(right, keys, how)
    return hot_join_with(hot, left, right, keys, how, spread_by)


def hot_join_with(hot: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: Column) -> DataFrame:
    """`hot_join` for hot groups that are already known."""
    hot = F.broadcast(hot.select(*keys, "_parts"))
    left_parts = _numbered(left.join(hot, keys, "left"), spread_by, "_part")
    right_parts = (
        right.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return left_parts.join(right_parts, [*keys, "_part"], how).drop("_part")

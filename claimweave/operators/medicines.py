"""Purchased medicines without a prescribed counterpart.

A purchased name matches when its key equals, contains or is contained in the key of a prescribed name of the same claim.
`unmatched_in_row` compares the two lists of one claim inside its row; `unmatched_by_join` is the same rule over an index of the rarest
grams, for claims with too many names to compare pairwise. `unmatched_medicines` picks per claim.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import name_key
from claimweave.session import materialize

# Claims with more pairs of names than this are matched by joins instead of inside their row.
MAX_PAIRS = 10_000_000

# Claims with more names than this are not gathered, also where there is nothing to compare them with.
MAX_NAMES = 1_000_000

# Names are indexed by pieces of so many characters, shorter ones whole.
GRAM = 3
# Names under one gram that are compared one by one, at most.
MOST_HOLDERS = 200

# Substrings longer than this are compared by digest, so that rows stay short.
PLAIN_KEY_CHARS = 32


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` looks at it for the elements of a list."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unmatched_in_row(purchased: Column, prescribed: Column) -> Column:
    """Names in `purchased` that match nothing in `prescribed`; both are arrays of distinct texts. Each key is made once."""
    keys = F.array_distinct(F.transform(prescribed, name_key))
    named = F.transform(purchased, lambda name: F.struct(name.alias("name"), name_key(name).alias("key")))

    def left_over(others: Column) -> Column:
        return F.filter(named, lambda own: ~F.exists(others, lambda other: own["key"].contains(other) | other.contains(own["key"])))

    return F.transform(_bound(keys, left_over), lambda own: own["name"])


def distinct_medicines(flattened: DataFrame) -> DataFrame:
    """One row per claim, side and spelling, with its comparison key; other columns must depend on the claim only."""
    return flattened.distinct().withColumn("key", name_key(F.col("medicine")))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that are joined by shuffling, whatever the size of their files.

    Names and grams repeat, so a file of them is a hundredth of what it is in memory; by its size Spark would send it whole to the driver.
    """
    return rows.hint("merge")


def _grams(key: Column, sizes: Column) -> Column:
    """Distinct pieces of a key that have one of the sizes, as bytes; keys are ASCII, so bytes are characters."""
    chars = F.length(key)
    text = key.cast("binary")

    def pieces(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(chars - size + 1, F.lit(1)))
        return F.when(size <= chars, F.transform(starts, lambda at: F.substring(text, at, size))).otherwise(F.array().cast("array<binary>"))

    return F.array_distinct(F.flatten(F.transform(sizes, pieces)))


def _containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(claim_id, inner, outer): ids of keys of `inner` that are part of a key of `outer` in the same claim. Both have claim_id, key, id.

    A key that holds another holds all of its grams, so it is enough to look under the one gram of the inner key that the fewest outer keys
    have; each find is verified. An inner key whose every gram is in more than MOST_HOLDERS outer keys is looked up by equality with their
    substrings of its length instead: `outer` alone is given for those, `inner` is NULL.
    """
    size = F.least(F.length("key"), F.lit(GRAM))
    sizes = inner.groupBy("claim_id").agg(F.collect_set(size).alias("sizes"))  # of four numbers at most
    holders = materialize(
        outer.join(_dealt(sizes), "claim_id").select("claim_id", F.col("id").alias("outer"), F.explode(_grams(F.col("key"), F.col("sizes"))).alias("gram")), "grams"
    )
    held = holders.groupBy("claim_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.select("claim_id", F.col("id").alias("inner"), F.explode(_grams(F.col("key"), F.array(size))).alias("gram"))
    # A gram that no outer key has settles that there is no find; it is the rarest of all.
    rarest = asked.join(_dealt(held), ["claim_id", "gram"], "left").groupBy("claim_id", "inner").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("rarest")
    ).filter(F.col("rarest.n") > 0).select("claim_id", "inner", "rarest.n", "rarest.gram")
    rarest = materialize(rarest, "rarest-grams")
    met = rarest.filter(F.col("n") <= MOST_HOLDERS).drop("n").join(_dealt(holders), ["claim_id", "gram"]).select("claim_id", "inner", "outer")
    met = met.join(_dealt(inner.select("claim_id", F.col("id").alias("inner"), F.col("key").alias("small"))), ["claim_id", "inner"])
    met = met.join(_dealt(outer.select("claim_id", F.col("id").alias("outer"), F.col("key").alias("large"))), ["claim_id", "outer"])
    found = met.filter(F.col("large").contains(F.col("small"))).select("claim_id", "inner", "outer")
    common = rarest.filter(F.col("n") > MOST_HOLDERS).select("claim_id", F.col("inner").alias("id"))
    if common.isEmpty():
        return found
    return found.unionByName(_equal_pieces(inner.join(_dealt(common), ["claim_id", "id"], "left_semi"), outer))


def _digest(text: Column) -> Column:
    return F.when(F.length(text) <= PLAIN_KEY_CHARS, text).otherwise(F.sha2(text, 256))


def _equal_pieces(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """`_containments` by equality of substrings, without any pairs: for every inner and every outer key that is in one, a row of its own.

    An outer key gives length x distinct inner lengths short rows, however many keys it meets.
    """
    lengths = inner.groupBy("claim_id").agg(F.collect_set(F.length("key")).alias("sizes"))
    pieces = outer.join(_dealt(lengths), "claim_id").select("claim_id", "id", F.explode(_grams(F.col("key"), F.col("sizes"))).alias("piece"))
    pieces = pieces.select("claim_id", "id", _digest(F.col("piece").cast("string")).alias("piece"))
    wanted = inner.select("claim_id", "id", _digest(F.col("key")).alias("piece"))
    holds = pieces.join(_dealt(wanted.select("claim_id", "piece")), ["claim_id", "piece"], "left_semi")
    is_held = wanted.join(_dealt(pieces.select("claim_id", "piece")), ["claim_id", "piece"], "left_semi")
    none = F.lit(None).cast("string")
    return holds.select("claim_id", none.alias("inner"), F.col("id").alias("outer")).unionByName(is_held.select("claim_id", F.col("id").alias("inner"), none.alias("outer")))


def unmatched_by_join(medicines: DataFrame) -> DataFrame:
    """Rows of `distinct_medicines` that were purchased and match nothing prescribed in the same claim.

    Equal keys are found by a join; the names that are left, and prescribed ones of their claims alone, by a gram index of each side.
    """
    purchased = medicines.filter(F.col("side") == "PURCHASED").drop("side").withColumn("id", F.md5("key"))
    prescribed = medicines.filter(F.col("side") == "PRESCRIBED").select("claim_id", "key", F.md5("key").alias("id")).distinct()
    bought = purchased.select("claim_id", "key", "id").distinct()
    # One match settles a name, so each step takes only what the cheaper ones before it have left.
    left = materialize(bought.join(_dealt(prescribed.select("claim_id", "key")), ["claim_id", "key"], "left_anti"), "unequal-medicines")
    holding = prescribed.join(_dealt(left.select("claim_id").distinct()), "claim_id", "left_semi")
    around = _containments(holding, left).select("claim_id", F.col("outer").alias("id"))
    left = materialize(_without(left, around), "unheld-medicines")
    within = _containments(left, prescribed).select("claim_id", F.col("inner").alias("id"))
    unmatched = materialize(_without(left, within).select(F.col("claim_id").alias("_claim"), F.col("id").alias("_id")), "unmatched-medicines")
    # A name without a claim or a key matches nothing, so it is among them.
    same = F.col("claim_id").eqNullSafe(F.col("_claim")) & F.col("id").eqNullSafe(F.col("_id"))
    return purchased.join(_dealt(unmatched), same, "left_semi").drop("id")


def _without(names: DataFrame, matched: DataFrame) -> DataFrame:
    return names.join(_dealt(matched.filter(F.col("id").isNotNull()).distinct()), ["claim_id", "id"], "left_anti")


def unmatched_medicines(medicines: DataFrame, max_pairs: int = MAX_PAIRS, max_names: int = MAX_NAMES) -> DataFrame:
    """Purchased names without a match, each claim matched in the way that suits its size.

    `medicines` (`distinct_medicines`) is counted first, so it should be a table.
    """
    prescribed = F.col("side") == "PRESCRIBED"
    sizes = medicines.groupBy("claim_id").agg(
        F.count_if(prescribed).cast("double").alias("prescribed"), F.count_if(~prescribed).cast("double").alias("purchased")
    )
    wide = sizes.filter((F.col("prescribed") * F.col("purchased") > max_pairs) | (F.col("prescribed") + F.col("purchased") > max_names))
    if wide.isEmpty():
        return _unmatched_by_row(medicines)
    ids = materialize(wide.select("claim_id"), "wide-claims")

    def pick(how: str) -> DataFrame:
        return medicines.join(ids, "claim_id", how)

    joined = unmatched_by_join(pick("left_semi")).select("claim_id", "medicine")
    return _unmatched_by_row(pick("left_anti")).unionByName(joined)


def _unmatched_by_row(medicines: DataFrame) -> DataFrame:
    def names(side: str) -> Column:
        return F.collect_list(F.when(F.col("side") == side, F.col("medicine"))).alias(side.lower())

    # Dealt as they are: lists of a few names each, made before the shuffle, take more bytes than the names and a sort of every task's rows.
    lists = medicines.repartition("claim_id").groupBy("claim_id").agg(names("PRESCRIBED"), names("PURCHASED"))
    unmatched = unmatched_in_row(F.col("purchased"), F.col("prescribed"))
    return lists.select("claim_id", F.explode(unmatched).alias("medicine"))

"""Mixing sources to target weights by Poisson replication.

A source's target rate is the mean number of times each of its documents is wanted: its target share of all characters over its
actual share, times `epochs`. A document's count is drawn from a Poisson distribution of that mean by inversion: a uniform
number from a hash of seed and id is looked up in the cumulated probabilities. Counts need no state and no second pass, come out
the same wherever a row is processed, and keep every source's expected total exactly at its target.

A large mean is the sum of equal parts of at most `PART_MEAN`, each inverted with a number of its own, so tables of probabilities stay
short and sums exact to a double's precision. Copies are ordered by a hash of seed, id and copy over the whole table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

PART_MEAN = 8.0
#: Entries of a table of cumulated probabilities; beyond, less than 2 ** -60 is left for any mean up to PART_MEAN.
TABLE = 60
#: More sources than this are joined by shuffling; a row takes some 600 bytes.
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column) -> Column:
    """A number from 0 (included) to 1 from the first 52 bits of the MD5 of the parts, joined by colons; nulls are empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, n_chars, rate, parts, cumulated): a row per source, however many there are.

    A text counts with its characters, at least one. Without weights every source has the same; with them, sources that are not
    named have weight 0 and are left out of the mix. A null source is one of its own, named by None.
    """
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_chars"))
    if weights is None:
        weighed = sources.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, weight double")
        weighed = sources.join(named, F.col("source").cast("string").eqNullSafe(F.col("_source")), "left").drop("_source").na.fill({"weight": 0.0})
    weighed = materialize(weighed, "sources")
    sums = weighed.agg(F.sum("n_chars").alias("chars"), F.sum("weight").alias("weight")).first()
    rate = F.lit(float(epochs)) * F.col("weight") / F.lit(sums.weight) * F.lit(sums.chars) / F.col("n_chars")
    rated = weighed.where("weight > 0").withColumn("rate", rate)
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    # Probability of k from that of k - 1; the running sums are the table.
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE - 1)), start,
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums")
        ),
    )["sums"]
    return rated.select("source", "n_docs", "n_chars", "rate", "parts", table.alias("cumulated"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """The rows of `docs`, each as often as drawn, in a global random order; all columns, then n_copies, copy and position.

    `copy` counts from 1 to `n_copies`; `position` (0 to 1) is what the copies are ordered by. Null and empty texts count as one
    character. A null id is hashed as the empty text; rows of equal id get equal counts. Sources without weight, and documents with a
    count of zero, are not in the mix, as the method has it. An empty table gives an empty one. Columns of `docs` that have the name of an
    added one are replaced.
    """
    rates = source_rates(docs, weights, epochs).select("source", "rate", "parts", "cumulated")
    rates = materialize(rates.toDF("_source", "_rate", "_parts", "_cumulated"), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    plain = docs.drop("n_copies", "copy", "position")
    # Each document finds one row. With too many sources to broadcast, adaptive execution splits the hot ones.
    rated = plain.join(rates, F.col("source").eqNullSafe(F.col("_source")))

    def draw(part):
        number = uniform(F.lit(seed), F.col("doc_id"), part)
        return F.size(F.filter("_cumulated", lambda bound: bound <= number))

    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda total, part: total + draw(part))
    drawn = rated.withColumn("n_copies", count).where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    placed = copies.withColumn("position", uniform(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy")))
    return placed.select(*plain.columns, "n_copies", "copy", "position").orderBy("position", "doc_id", "copy")

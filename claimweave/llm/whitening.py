"""Whitening of embeddings from a covariance weighted by multiplicity.

Entries become integers, so equal vectors are found exactly: they are grouped once, and their number (or one) is the weight of the distinct
vector in everything that follows. Sums are exact integers. The covariance is a weighted matrix product of centred slices, one small matrix per
task, added in a tree. Every distinct vector is whitened once; rows find theirs by a 128-bit hash of it, so no vector is moved twice.

What goes to the driver is a square of the dimension: the covariance, whose eigenvectors go back to the tasks.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Partial matrices that are added in one group.
_FAN = 64
#: Numbers of a slice of vectors that are worked on at a time.
_SLICE = 1 << 19
#: Below this share of the largest eigenvalue a direction has no spread that doubles could tell from rounding.
_FLAT = 1e-12


def as_integers(vector: Column) -> Column:
    """floor(1024 * entry) + 100000 of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """False for null and empty vectors and those with entries that are null, not finite, or so large that no long holds them."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 52), F.lit(False))), F.lit(False))


def _vectors(batches, dimension):
    """(start, x, weight) by slices of Arrow batches of (x, weight): x as a matrix of longs."""
    most = max(1, _SLICE // dimension)
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            x = part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            yield part, x.reshape(-1, dimension), part.column(part.schema.get_field_index("weight")).to_numpy()


def _exact_sum(x, weight):
    """Weighted sums by dimension as Python integers."""
    if float(np.abs(x).max(initial=0)) * float(weight.sum()) < 2.0**62:
        return [int(v) for v in (x * weight[:, None]).sum(0)]
    return [int(v) for v in (x.astype(object) * weight.astype(object)[:, None]).sum(0)]


def _column_sums(distinct: DataFrame, dimension: int) -> list[int]:
    def partial(batches):
        sums = [0] * dimension
        for _, x, weight in _vectors(batches, dimension):
            sums = [a + b for a, b in zip(sums, _exact_sum(x, weight), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["at", "total"])

    parts = distinct.select("x", "weight").mapInArrow(partial, "at int, total decimal(38,0)")
    return [int(r.total) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()]


def _centred(x, n, total):
    """x - total / n, by whole and broken parts, so that large shifts cost no digits."""
    whole = np.array([t // n for t in total], np.int64)
    return (x - whole).astype(float) - np.array([t % n / n for t in total])


def _moments(rows: DataFrame, width: int, slices) -> np.ndarray:
    """Sum over all rows of weight * z z'. `slices` gives (z, weight) for the batches of a task.

    A task gives one matrix, row by row; a group adds a matrix row of up to `_FAN` tasks, until one is left.
    """

    def partial(batches):
        total = np.zeros((width, width))
        for z, weight in slices(batches):
            total += (z * weight[:, None]).T @ z
        part = np.full(width, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total])], ["part", "at", "sums"])

    def add(key, table):
        sums = np.stack([np.frombuffer(b) for b in table["sums"].to_pylist()]).sum(0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()])})

    names = "part int, at int, sums binary"
    sums = materialize(rows.mapInArrow(partial, names), "moments")
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        grouped = sums.select(F.floor(F.col("part") / _FAN).cast("int").alias("part"), "at", "sums").groupBy("part", "at")
        sums = materialize(grouped.applyInArrow(add, names), "moments")
        parts = -(-parts // _FAN)
    found = np.zeros((width, width))
    for r in sums.collect():
        found[r.at] += np.frombuffer(r.sums)
    return found


def _deviation(x, z, n, total):
    """Sum over dimensions of (n * x - total) ** 2 as Python integers, None where a long can't hold it."""
    rough = ((z * n) ** 2).sum(1)
    if float(np.abs(x).max(initial=0)) * n < 2.0**62 and max(map(abs, total)) < 2**62:
        # Rows that fit are below 2 ** 63, so unsigned sums of squares are exact; the others are known from the rough figure.
        apart = np.abs(x * n - np.array(total, np.int64)).astype(np.uint64)
        exact = [int(v) for v in (apart * apart).sum(1, dtype=np.uint64)]
    else:
        rows = x.astype(object) * n - np.array(total, object)
        exact = (rows * rows).sum(1).tolist()
    return [v if r < 1.01 * 2.0**63 and v < 2**63 else None for v, r in zip(exact, rough.tolist(), strict=True)]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, multiplicity: bool = True) -> DataFrame:
    """A row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    x is `as_integers` of a vector; n vectors with sums S are fitted: all usable rows, or with `multiplicity` False each distinct x once.
    Components are eigenvectors of the covariance of x (divisor n), numbered from 1 by falling eigenvalue, the largest entry of each positive. whitened is
    x - S / n, projected on the component, over the root of its eigenvalue; explained the eigenvalue's share of the trace; identity_error the largest
    entry by size of the covariance of whitened over the fitted vectors, minus the identity; deviation the exact sum over dimensions of
    (n * x - S) ** 2, null where a long can't hold it.

    Not usable, and left out: rows whose vector is null, empty or has null or non-finite entries, entries from 2 ** 52 on, and vectors of another length
    than the most frequent one (of equally frequent ones the longest). Directions without spread have no rows, so equal vectors alone, or an
    empty table, give none. Repeated and null keys keep a row each. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(key).alias("key"), F.col(column).alias("c")).where(usable(F.col("c"))).select("key", as_integers(F.col("c")).alias("x"))
    result = [F.col("key").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    count = F.count(F.lit(1)) if multiplicity else F.lit(1).cast("long")
    distinct = materialize(kept.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), count.alias("weight")), "distinct")
    lengths = distinct.groupBy(F.size("x").alias("dimension")).agg(F.sum("copies").alias("rows"), F.sum("weight").alias("n"))
    longest = lengths.orderBy(F.desc("rows"), F.desc("dimension")).limit(1).collect()
    names = f"key {dict(kept.dtypes)['key']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not longest:
        return spark.createDataFrame([], names).select(*result)
    dimension, n = longest[0].dimension, longest[0].n
    distinct = distinct.where(F.size("x") == dimension)
    total = _column_sums(distinct, dimension)

    def centred(batches):
        for _, x, weight in _vectors(batches, dimension):
            yield _centred(x, n, total), weight

    covariance = _moments(distinct.select("x", "weight"), dimension, centred) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    most = min(components, int((values > max(values[0], 0) * _FLAT).sum())) if values[0] > 0 else 0
    if not most:
        return spark.createDataFrame([], names).select(*result)
    axes = axes[:, :most] * np.sign(axes[np.abs(axes[:, :most]).argmax(0), range(most)])
    basis = axes / np.sqrt(values[:most])
    share = [float(v) for v in values[:most] / values.sum()]

    def project(batches):
        for part, x, weight in _vectors(batches, dimension):
            z = _centred(x, n, total)
            white = z @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, most, dtype=np.int32)), pa.array(white.ravel()))
            given = [part.column(part.schema.get_field_index(name)) for name in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(weight), pa.array(_deviation(x, z, n, total), pa.int64()), lists], ["h1", "h2", "weight", "deviation", "white"])

    hashes = [F.xxhash64(F.lit(seed), F.col("x")).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    white = distinct.select(*hashes, "x", "weight").mapInArrow(project, "h1 long, h2 long, weight long, deviation long, white array<double>")
    white = materialize(white, "white")

    def whitened(batches):
        for batch in batches:
            weight = batch.column(0).to_numpy().astype(float)
            z = batch.column(1).flatten().to_numpy().reshape(-1, most)
            # A column of ones gives the sums along with the products.
            yield np.column_stack([z, np.ones(len(z))]), weight

    moments = _moments(white.select("weight", "white"), most + 1, whitened) / n
    mean = moments[:most, most]
    error = float(np.abs(moments[:most, :most] - np.outer(mean, mean) - np.eye(most)).max())
    rows = kept.select("key", *hashes).join(white, ["h1", "h2"])
    exploded = rows.select("key", "deviation", F.posexplode("white").alias("at", "whitened"))
    return exploded.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, share)), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )

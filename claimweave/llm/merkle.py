"""A Merkle manifest of a dataset by lag and lead windows.

Rows are leaves; per group they form a tree in their order, and the groups' roots form one more tree. A node of level l stands on the
row of its first leaf, so the nodes beside it stand at fixed offsets: at level l, lags and leads by 1 to fanout - 1 times fanout ** l, masked by the
node's slot in its run and by the length of the run, are its siblings. First children hash their run and so hold the parent of the next level.

One window partition is a block of at most `BLOCK` leaves: its levels are a chain of windows over one shuffle and one sort, and a
running last value hands every node's siblings on to the leaves below it. The nodes on top of the blocks are the leaves of the next
tier, fewer by the size of a block. So neither a group of a third of all rows nor many small ones land in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.numbering import numbered
from claimweave.session import materialize

FANOUT = 2
#: Most leaves of a window partition.
BLOCK = 1024

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(encoded, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up lead to."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["left"], node, beside["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""))


def _levels(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _tier(nodes: DataFrame, fanout: int) -> DataFrame:
    """`nodes` (group_key, position, n, node, more) with block, path and top: siblings up to the block's own node, and that node."""
    levels = _levels(fanout)
    rows = nodes.withColumn("block", F.expr(f"position div {fanout ** levels}")).withColumn("node0", F.col("node"))
    order = Window.partitionBy("group_key", "block").orderBy("position")
    for level in range(levels):
        step, node = fanout**level, F.col(f"node{level}")
        count = F.expr(f"(n + {step - 1}) div {step}")  # nodes of the group on this level
        index = F.expr(f"position div {step}")
        slot = index % fanout
        run = F.least(F.lit(fanout), count - index + slot)
        left = [F.when(slot >= j, F.lag(node, j * step).over(order)).otherwise("") for j in range(fanout - 1, 0, -1)]
        right = [F.when(slot + j < run, F.lead(node, j * step).over(order)).otherwise("") for j in range(1, fanout)]
        stands = F.col("position") % step == 0
        rows = rows.select("*", F.concat(*left).alias("_left"), F.concat(*right).alias("_right"))
        parent = F.when(count > 1, digest(node, F.col("_right"))).otherwise(node)
        beside = F.when(stands & (count > 1), F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        first = F.col("position") % (step * fanout) == 0
        rows = rows.select("*", F.when(first, parent).alias(f"node{level + 1}"), beside.alias(f"beside{level}")).drop("_left", "_right")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array(*(F.last(f"beside{level}", ignorenulls=True).over(so_far) for level in range(levels)))
    top = F.last(f"node{levels}", ignorenulls=True).over(so_far)
    rows = rows.select(*nodes.columns, "block", path.alias("path"), top.alias("top"))
    return rows.withColumn("path", F.filter("path", lambda beside: beside.isNotNull()))


def _paths(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """`leaves` (group_key, position, n, node, more) with their path to the group's root, and (group_key, node): the roots."""
    size = fanout ** _levels(fanout)
    tiers, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops = _tier(tiers[-1].select("group_key", "position", "n", "node"), fanout).where(F.col("position") % size == 0)
        higher = F.expr(f"(n + {size - 1}) div {size}").alias("n")
        tiers.append(materialize(tops.select("group_key", F.col("block").alias("position"), higher, F.col("top").alias("node")), "tier"))
        most = -(-most // size)
    roots = tiers.pop()
    if not tiers:
        return leaves.withColumn("path", F.array().cast(_PATH)), roots.select("group_key", "node")
    above = None
    for nodes in reversed(tiers):
        found = _tier(nodes, fanout)
        if above is not None:
            found = found.join(above, ["group_key", "block"]).withColumn("path", F.concat("path", "further"))
        found = found.select(*nodes.columns, "path")
        if nodes is not leaves:
            above = materialize(found.select("group_key", F.col("position").alias("block"), F.col("path").alias("further")), "paths")
    return found, roots.select("group_key", "node")


def merkle_manifest(
    docs: DataFrame, values: list[str], group: str = "lang", order: str = "doc_id", carried: dict[str, Column] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """A row per row of `docs`: order and group column, `carried` columns, leaf, position, path, subroot and root.

    leaf is the digest of the `values` columns; per group, leaves ascend by `order`, where equal ones by leaf; repeated rows are leaves of their own.
    A run of up to `fanout` nodes has one parent until one node is left: subroot. Subroots, by group (null first, then by
    bytes of its text), lead to the root in the same way. path holds for every level up to the root what stands left and right of the
    leaf's ancestor in its run. Nulls are a value of their own; texts of any length are hashed in place and never moved. An empty
    table gives an empty one. Columns of `docs` that are not named are not read.
    """
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    also = carried or {}
    leaves = docs.select(
        group_key.alias("group_key"), F.col(order).alias("order_key"), F.col(group).alias("group_value"), leaf_digest(*map(F.col, values)).alias("node"),
        *(column.alias(f"carried_{name}") for name, column in also.items()),
    )
    leaves = materialize(leaves, "leaves")
    found, subroots = _paths(numbered(leaves, "group_key", ["order_key", "node"]), fanout)
    subroots = materialize(subroots.select(F.lit("").alias("group_key"), F.col("group_key").alias("of"), "node"), "subroots")
    higher, root = _paths(numbered(subroots, "group_key", ["of"]), fanout)
    root = root.select(F.col("node").alias("root"))
    # One row, or none of an empty table.
    higher = higher.join(F.broadcast(root)).select(F.col("of").alias("group_key"), F.col("node").alias("subroot"), F.col("path").alias("further"), "root")
    joined = found.join(materialize(higher, "higher"), "group_key")
    return joined.select(
        F.col("order_key").alias(order), F.col("group_value").alias(group), *(F.col(f"carried_{name}").alias(name) for name in also),
        F.col("node").alias("leaf"), "position", F.concat("path", "further").alias("path"), "subroot", "root",
    )


def tampered_leaf(docs: DataFrame) -> Column:
    """Of documents whose crc32(doc_id as text) 7 divides: the leaf with n_chars one higher (null stays null); else null.

    A null id is not tampered with.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))


VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and what the proof gives for a tampered leaf, or the original one.

    Rows whose id has a crc32 that 7 divides are tampered with (`tampered_leaf`); `verified` says whether folded_root is the root.
    """
    found = merkle_manifest(docs, VALUES, carried={"tampered": tampered_leaf(docs)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    shown = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded)
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))

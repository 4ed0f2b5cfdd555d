"""Connected components of a graph held as a table of edges, by contraction.

In a round every node points to its smallest neighbour, or to itself if none is smaller. Pointers lead to ever smaller nodes, so following
them (by doubling) ends at the smallest node of a tree; trees become single nodes, edges inside them vanish and the
rest are joined into fewer. At least half of the nodes that have an edge go in a round, most of a dense group at once.

Every step is a grouped minimum (combined on the map side) or an equi-join with a table of unique nodes, which adaptive execution can split at
a node with many edges; no node's edges are gathered in one place. Steps are written to the shared scratch folder: a lost executor
repeats part of one step.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a < b): the end of its way over smallest neighbours."""
    both = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")).union(edges.select("a", "a").distinct())
    up = materialize(both.groupBy("node").agg(F.min("up").alias("up")), "pointers")
    while True:
        above = up.where("up <> node").toDF("up", "further")
        # A pointer to a node that points on is doubled; the others are at their root.
        if above.join(up.where("up <> node").select("up").distinct(), "up", "left_semi").isEmpty():
            return up.withColumnRenamed("up", "root")
        up = materialize(up.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up")), "pointers")


def _plain(edges: DataFrame) -> DataFrame:
    a, b = edges.columns[:2]
    ordered = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return materialize(ordered.where("a < b").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges`, whose first two columns are the ends; component is its smallest node.

    Ends must be of one comparable type. Loops, repeated and reversed edges are allowed; rows with a null end are ignored. A
    node that has only loops is not returned; an empty table gives an empty one.
    """
    left = _plain(edges)
    rounds = []
    while not left.isEmpty():
        roots = _pointers(left)
        rounds.append(roots)
        moved = left.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b")
        left = _plain(moved.select("x", "y"))
    if not rounds:
        return left.toDF("node", "component")
    # The nodes of a round are roots of the round before; answers go back from the last round to the first.
    found = rounds.pop()
    while rounds:
        found = rounds.pop().join(found.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        found = materialize(found, "roots")
    return found.toDF("node", "component")

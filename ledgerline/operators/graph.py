"""Connected components by alternating large and small stars, entirely in joins and aggregates.

No adjacency list is ever gathered: each round replaces links by links to the
smallest neighbour, found with ``min`` (which combines before the shuffle), so
a node with any number of neighbours is one row of partial sums per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.tables import materialize, shuffled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has a link; component is the smallest reachable node.

    ``edges`` has two orderable columns ``a`` and ``b``. Loops, repeated links and
    both directions are allowed; no links give no rows. Rounds end when a pass
    changes nothing; each is cut off from its lineage by a shared table.
    """
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    before = None
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def subtrees(nodes: DataFrame, id_col: str, parent_col: str, max_depth: int = 1 << 20) -> DataFrame:
    """(node, root, depth) for every node of a forest, by following parents; a null or unknown parent makes a root.

    Pointers are doubled each round, so depth costs its logarithm in joins. Nodes
    deeper than ``max_depth``, or parents in a circle, are an error.
    """
    links = nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("up"))
    known = links.select(F.col("node").alias("known"))
    links = links.join(known, F.col("up") == F.col("known"), "left").select("node", F.coalesce("known", "node").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).alias("depth"))
    links, step = materialize(links), 1
    while True:
        above = links.select(F.col("node").alias("mid"), F.col("up").alias("top"), F.col("depth").alias("more"))
        jumped = links.join(above, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        jumped = materialize(jumped)
        if jumped.agg(F.sum("depth")).first() == links.agg(F.sum("depth")).first():
            return links.select("node", F.col("up").alias("root"), "depth")
        if step >= max_depth:
            raise RuntimeError(f"nodes lie deeper than {max_depth}, or parents form a circle")
        links, step = jumped, 2 * step


def trails(nodes: DataFrame, id_col: str, parent_col: str, label_col: str, max_depth: int = 1 << 20) -> DataFrame:
    """(node, root, depth, trail) for every node of a forest: the labels from its root down to itself, as an array.

    Each round joins a node's stretch of labels to that of the node above it, which doubles what stretches hold, so
    a depth costs its logarithm in joins; a node whose stretch reaches its root takes no further part. A null or
    unknown parent makes a root. Nodes deeper than ``max_depth``, or parents in a circle, are an error.
    """
    links = nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("up"), F.array(F.col(label_col)).alias("trail"))
    known = links.select(F.col("node").alias("known"))
    links = links.join(known, F.col("up") == F.col("known"), "left").select("node", F.col("known").alias("up"), "trail", F.lit(0).alias("depth"), F.col("node").alias("top"))
    links, done, step = materialize(links), [], 1
    while True:
        ended = links.where("up is null")
        done.append(ended)
        waiting = links.where("up is not null")
        if waiting.isEmpty():
            break
        if step > max_depth:
            raise RuntimeError(f"nodes lie deeper than {max_depth}, or parents form a circle")
        above = links if len(done) == 1 else reduce(DataFrame.unionByName, done[:-1], links)
        above = above.select(F.col("node").alias("mid"), F.col("up").alias("next"), F.col("trail").alias("before"), F.col("depth").alias("more"), F.col("top").alias("higher"))
        joined = waiting.join(above, F.col("up") == F.col("mid"))
        links = materialize(joined.select("node", F.col("next").alias("up"), F.concat("before", "trail").alias("trail"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.col("higher").alias("top")))
        step *= 2
    return reduce(DataFrame.unionByName, done).select("node", F.col("top").alias("root"), "depth", "trail")

"""Paths between pairs of nodes, by distances to their ends that all pairs with one end share."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import counted, cut


#: Edges that are sent to every task at most: two names a row, so some 30 MB.
SMALL = 500_000
#: Walks that a search may follow from one table to the next, by the largest number of edges into a node; and hops.
WALKS, STRIDE = 1 << 20, 8


class Hops:
    """The distinct edges (_s, _t) in a table that every round reads."""

    def __init__(self, edges: DataFrame):
        known = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
        self.table, self.rows = counted(known)
        self.small = self.rows <= SMALL
        self.read = F.broadcast(self.table) if self.small else self.table
        self.into = max(2, self.table.groupBy("_t").count().agg(F.max("count")).first()[0] or 0) if self.small else 0

    def stride(self, rows: int) -> int:
        """Hops from a frontier of so many rows that make at most WALKS rows, if edges need no shuffle; else one at a time."""
        n = 1
        while self.small and n < STRIDE and rows * self.into ** (n + 1) <= WALKS:
            n += 1
        return n


def distances(hop: Hops, pairs: DataFrame, depth: int | None = None, whole: bool = False) -> DataFrame:
    """dst, node, hops: how many edges part a node from the end of a pair at least.

    One breadth-first search for each end, not for each pair, over reversed edges and all of them
    in step: a level is a table of ends and nodes, and no row holds a path. An end whose starts are
    all reached is not followed any more, unless the whole of what leads to it is asked for. Few
    short steps are taken at once, and the least number of them counts.
    """
    level, rows = counted(pairs.select("dst", F.col("dst").alias("node"), F.lit(0).alias("hops")).distinct())
    seen, at = level, 0
    for i in itertools.count(1):
        step = min(hop.stride(rows), depth - at if depth is not None else STRIDE)
        if step < 1:
            break
        front = level.where(F.col("hops") == at).select("dst", "node")
        if not whole:
            open_ = pairs.join(seen.select("dst", F.col("node").alias("src")), ["dst", "src"], "left_anti").select("dst").distinct()
            front = front.join(open_, "dst", "left_semi")
        reached = None
        for n in range(1, step + 1):
            front = front.join(hop.read, F.col("node") == F.col("_t")).select("dst", F.col("_s").alias("node"))
            now = front.withColumn("hops", F.lit(at + n))
            reached = now if reached is None else reached.unionByName(now)
        reached = reached.groupBy("dst", "node").agg(F.min("hops").alias("hops"))
        level, rows = counted(reached.join(seen.select("dst", "node"), ["dst", "node"], "left_anti"))
        at += step
        if not rows:
            break
        seen = seen.unionByName(level)
        if i % 8 == 0:
            seen = cut(seen)
    return seen


def _grown(front: DataFrame, hop: Hops, far: DataFrame) -> DataFrame:
    """Prefixes one hop on (next, rest: how far it is from there), where that doesn't close a cycle and leads to the end."""
    on = front.join(hop.read, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_t"))).drop("_s")
    return on.join(far.select("dst", F.col("node").alias("_t"), F.col("hops").alias("rest")), ["dst", "_t"]).withColumn("path", F.array_append("path", F.col("_t")))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int | None = None, most: int = 5) -> DataFrame:
    """src, dst, path, hops: all shortest paths of each pair (src, dst), `most` at most, in order of their nodes.

    Distances to the ends come first (see distances()). A walk from the starts then takes only edges that come one hop
    nearer, so each prefix arrives, and the first `most` prefixes of a pair are all that its result
    can hold: rows stay in proportion to the pairs. depth: hops at most, if given. A node is its
    own path of no hops; nulls have none; repeated pairs count once.
    """
    hop, pairs = Hops(edges), cut(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    far = cut(distances(hop, pairs, depth))
    front = cut(pairs.join(far.withColumnRenamed("node", "src"), ["dst", "src"]).select("src", "dst", F.array("src").alias("path"), "hops", F.col("hops").alias("rest")))
    longest = front.agg(F.max("hops")).first()[0] or 0
    first = Window.partitionBy("src", "dst").orderBy("path")
    done = front.where("rest = 0")
    for i in range(1, longest + 1):
        near = _grown(front.where("rest > 0").withColumnRenamed("rest", "_r"), hop, far).where("rest = _r - 1")
        front = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("src", "dst", "path", "hops", "rest")
        if i < longest and (i % STRIDE == 0 or not hop.small):
            front = cut(front)
        done = done.unionByName(front.where("rest = 0"))
    return done.select("src", "dst", "path", "hops")


def _near(edges: Hops, far: DataFrame) -> tuple[DataFrame, bool]:
    """dst, _f, _t, rest: the edges that lead to each end, with how far it is from there; and whether they fit a broadcast."""
    near, rows = counted(edges.table.join(far.select("dst", F.col("node").alias("_t"), F.col("hops").alias("rest")), "_t").select("dst", F.col("_s").alias("_f"), "_t", "rest"))
    return (F.broadcast(near), True) if rows <= SMALL else (near, False)


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 5, depth: int | None = None) -> DataFrame:
    """src, dst, path, hops: the `most` shortest paths of each pair that visit no node twice, in order of length and nodes.

    The distance from a prefix's last node to the end bounds the length that it can have there, and nodes that don't lead
    to the end are never entered. A prefix that was never nearer to the end than it is now surely has a path of that
    length, since what is left visits nearer nodes only. What a pair's prefixes lead to comes in the order of their bounds and nodes: those
    that come after `most` sure ones are not needed, and of the others the first `most` are taken a
    hop on in each round. So rows stay in proportion to the pairs while prefixes are sure, however many paths there are.
    depth: hops at most, if given. A node is its own path of no hops.
    """
    hop, pairs = Hops(edges), cut(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    far = cut(distances(hop, pairs, depth, whole=True))
    near, small = _near(hop, far)
    start = pairs.join(far.withColumnRenamed("node", "src"), ["dst", "src"]).select("src", "dst", F.array("src").alias("path"), F.col("hops").alias("bound"), F.col("hops").alias("left"), F.col("hops").alias("low"))
    rows, going = counted(start)
    order = Window.partitionBy("src", "dst").orderBy("bound", "path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    while going:
        for _ in range(STRIDE if small else 1):
            ranked = rows.withColumns({"_n": F.row_number().over(order), "_sure": F.coalesce(F.count_if(F.col("left") <= F.col("low")).over(before), F.lit(0))}).where(F.col("_sure") < most)
            ranked = ranked.withColumn("_open", (F.col("left") > 0) & (F.col("_n") <= most)).withColumn("_f", F.when(F.col("_open"), F.element_at("path", -1)))
            on = ranked.join(near, ["dst", "_f"], "left").where(~F.col("_open") | (F.col("_t").isNotNull() & ~F.array_contains("path", F.col("_t"))))
            step = lambda new, old: F.when(F.col("_open"), new).otherwise(F.col(old)).alias(old)
            rows = on.select("src", "dst", step(F.array_append("path", F.col("_t")), "path"), step(F.size("path") + F.col("rest"), "bound"), step(F.col("rest"), "left"), step(F.least("low", "rest"), "low"))
            if depth is not None:
                rows = rows.where(F.col("bound") <= depth)
        rows = cut(rows)
        going = not rows.where("left > 0").isEmpty()
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("src", "dst", "path", F.col("bound").alias("hops"))

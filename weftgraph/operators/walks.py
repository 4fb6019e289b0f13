"""Bounded walks: breadth-first frontiers as joins, one level at a time.

All walks are keyed by their start, so any number of starts advance together.
A node counts once, at its shortest distance; the start is never reached.
Levels are staged in the shared folder where more of them follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import QueryError
from ..sources.staging import staged

LAZY_LEVELS = 2  # levels that may be recomputed instead of staged


@dataclass
class Work:
    """What the walks and paths of one statement have read; an error beyond the budget.

    Counting costs a job for each level, so plans only carry it on request.
    """

    budget: int | None = None
    nodes_expanded: int = 0
    relationships_read: int = 0

    def level(self, frontier: DataFrame, adjacency: DataFrame, back: bool = False) -> None:
        """Count one step of ``frontier`` (node) along ``adjacency``, or back along it."""
        far = adjacency.groupBy(F.col("dst" if back else "src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        met = frontier.select("node").join(far, "node", "left").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("read")).first()
        self.nodes_expanded += met.nodes
        self.relationships_read += met.read or 0
        if self.budget is not None and self.relationships_read > self.budget:
            raise QueryError(f"the walk reads more than {self.budget} relationships", hint="narrow the start, the condition or the hops")


def reach(starts: DataFrame, adjacency: DataFrame, low: int, high: int, arrivals: bool = False, work: Work | None = None) -> DataFrame:
    """``start, node, depth`` (and ``rel_id``) of nodes at a shortest distance in [low, high].

    ``starts`` has ``start`` (a key) and ``node``.  With ``arrivals``,
    ``rel_id`` is the edge by which a queue that reads nodes in the order in
    which it found them, and edges by (node, edge), first arrives; that needs
    the place of each node in the queue, so it costs a sort per level.
    """
    edges = adjacency.select("src", "dst", "rel_id")
    frontier = starts.select("start", "node", F.lit(0).cast("long").alias("place"))
    visited = starts.select("start", "node")
    found: list[DataFrame] = []
    for depth in range(1, high + 1):
        if work:
            work.level(frontier, edges)
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node"), "place", "rel_id")
        best = F.min(F.struct("place", "rel_id")) if arrivals else F.min("rel_id")
        step = step.groupBy("start", "node").agg(best.alias("by"))
        step = step.join(visited, ["start", "node"], "left_anti")
        if arrivals:
            place = F.row_number().over(Window.partitionBy("start").orderBy("by.place", "node"))
            step = step.select("start", "node", place.cast("long").alias("place"), F.col("by.rel_id").alias("rel_id"))
        else:
            step = step.select("start", "node", F.lit(0).cast("long").alias("place"), F.col("by").alias("rel_id"))
        if high > LAZY_LEVELS and depth < high:
            step = staged(step, "level")
            if step.isEmpty():
                break
        if depth >= low:
            found.append(step.withColumn("depth", F.lit(depth)))
        frontier = step.select("start", "node", "place")
        visited = visited.unionAll(frontier.select("start", "node"))
    keep = ["start", "node", "depth", "rel_id"] if arrivals else ["start", "node", "depth"]
    out = found[0] if found else frontier.filter(F.lit(False)).withColumn("depth", F.lit(0)).withColumn("rel_id", F.lit(0).cast("long"))
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*keep)


def within(ends: DataFrame, adjacency: DataFrame, high: int, work: Work | None = None) -> DataFrame:
    """``id`` of the nodes that reach another node of ``ends`` (id) in at most ``high`` hops.

    Walked backwards.  A node only has to know two different ends that it
    reaches, one of which is not itself, so every level has at most two rows
    for a node instead of one for each pair.
    """
    edges = adjacency.select("src", "dst").distinct()
    known = ends.select(F.col("id").alias("node"), F.array("id").alias("reached"))
    total = None
    for depth in range(1, high + 1):
        if work:
            work.level(known, edges, back=True)
        step = _two(edges.join(known, edges["dst"] == known["node"]).select(F.col("src").alias("id"), "reached"))
        # an end counts as reached for those who arrive at it
        known = step.unionAll(ends.select("id", F.array("id").alias("reached")))
        known = _two(known).withColumnRenamed("id", "node")
        total = step
        if high > LAZY_LEVELS and depth < high:
            known = staged(known, "ends")
    return total.filter(F.exists("reached", lambda x: x != F.col("id"))).select("id")


def _two(rows: DataFrame) -> DataFrame:
    """Two different reached ends of each id (least and greatest), so that map sides combine."""
    flat = rows.select("id", F.explode("reached").alias("end"))
    least = flat.groupBy("id").agg(F.min("end").alias("a"), F.max("end").alias("b"))
    return least.select("id", F.array_distinct(F.array("a", "b")).alias("reached"))

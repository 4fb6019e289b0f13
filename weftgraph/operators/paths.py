"""Shortest and cheapest routes from many starts at once.

Every start keeps the best record of each node that it has reached: its cost,
and the edge by which the least (cost, id) predecessor reached it.  Rounds
relax only what improved, until nothing does, and write only that: records lie
in layers, of which the least counts, merged every ``LAYERS`` rounds.  A
start's search is pruned by the best goal it knows.  Where the caller gives
points, no edge is shorter than its straight line (it is checked), so the line
to the nearest goal bounds the cost still ahead and prunes too, for up to
``GOALS_MOST`` goals; beyond, the answers are the same without that bound.

Among nodes of equal cost along edges of weight 0, records also keep a layer,
so predecessors never run in a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import merged, staged
from .walks import Work

MARGIN = 0.99  # an edge may be this much shorter than its straight line
LAYERS = 4
GOALS_MOST = 64


def _weight(adjacency: DataFrame, weight: str | None, kind: str, unit_metres: float | None) -> DataFrame:
    """``src, dst, rel_id, w, ahead``; bad weights raise where they are read."""
    if weight is None:
        return adjacency.select("src", "dst", "rel_id", F.lit(1.0).alias("w"), F.lit(0.0).alias("ahead"))
    w = F.col(f"&{weight}")
    named = lambda text: F.raise_error(F.concat(F.lit(f"{kind}#"), F.col("rel_id").cast("string"), F.lit(" from "), F.col("src").cast("string"), F.lit(" to "), F.col("dst").cast("string"), F.lit(text)))
    checked = F.when(w.isNull(), named(f" has no {weight}").cast("double")).when(w < 0, named(f" has a negative {weight}").cast("double")).otherwise(w.cast("double"))
    if unit_metres:
        line = F.col("line") / F.lit(unit_metres)
        checked = F.when(line.isNull(), named(" joins a node without its point").cast("double")).when(w < line * MARGIN, named(f" has a {weight} below the straight line between its ends").cast("double")).otherwise(checked)
    ahead = F.coalesce(F.col("ahead") / F.lit(unit_metres) * (MARGIN * (1 - 1e-9)), F.lit(0.0)) if unit_metres else F.lit(0.0)
    return adjacency.select("src", "dst", "rel_id", checked.alias("w"), ahead.alias("ahead"))


def _ahead(goals: DataFrame, points: DataFrame):
    """Metres from an edge's end to the nearest goal; null where goals are many or one has no point."""
    from ..functions import geo

    found = goals.join(points, goals["node"] == points["id"], "left").select("lat", "lon").limit(GOALS_MOST + 1).collect()
    if not found or len(found) > GOALS_MOST or any(r.lat is None or r.lon is None for r in found):
        return F.lit(None).cast("double")
    lines = [geo.haversine(F.col("pb.lat"), F.col("pb.lon"), F.lit(float(r.lat)), F.lit(float(r.lon))) for r in found]
    return lines[0] if len(lines) == 1 else F.least(*lines)


def routes(starts: DataFrame, adjacency: DataFrame, goals: DataFrame, weight: str | None = None, kind: str = "edge", bound: tuple[str, float] | None = None, points: DataFrame | None = None, unit_metres: float | None = None, work: Work | None = None) -> DataFrame:
    """``start, goal, cost, hops, nodes, rels`` of the best route of each start that has one.

    ``starts`` and ``goals`` have ``id``; ``bound`` is (< or <=, most).  With
    ``points`` (id, lat, lon) edges are checked against their straight lines.
    """
    from ..functions import geo

    goals = staged(goals.select(F.col("id").alias("node"), F.lit(True).alias("goal")).distinct(), "goals")
    edges = adjacency
    if points is not None:
        a = points.select(F.col("id").alias("src"), F.struct("lat", "lon").alias("pa"))
        b = points.select(F.col("id").alias("dst"), F.struct("lat", "lon").alias("pb"))
        edges = edges.join(merged(a), "src", "left").join(merged(b), "dst", "left")
        edges = edges.withColumn("line", geo.haversine(F.col("pa.lat"), F.col("pa.lon"), F.col("pb.lat"), F.col("pb.lon"))).withColumn("ahead", _ahead(goals, points))
    edges = _weight(edges, weight, kind, unit_metres if points is not None else None)
    if weight is not None or points is not None:
        edges = staged(edges, "weights")

    record = ["start", "node", "cost", "pcost", "layer", "pred", "rel"]
    none = F.lit(None).cast("long")
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.lit(-1.0).alias("pcost"), F.lit(0).alias("layer"), none.alias("pred"), none.alias("rel")).distinct()
    layers = [staged(first, "best")]
    frontier, rounds = layers[0], 0
    while True:
        best = _least(layers)
        known = best.join(merged(goals), "node").groupBy("start").agg(F.min("cost").alias("most"))
        step = frontier.join(merged(known), "start", "left").filter(F.col("most").isNull() | (F.col("cost") <= F.col("most")))
        if weight is None:  # a level at a time: whoever has a goal is done
            step = step.filter(F.col("most").isNull())
        if work:
            work.level(step, edges)
        step = step.join(merged(edges), step["node"] == edges["src"]).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("new"), F.col("cost").alias("pcost"), F.when(F.col("w") > 0, 0).otherwise(F.col("layer") + 1).alias("layer"), F.col("src").alias("pred"), F.col("rel_id").alias("rel"), "most", "ahead")
        total = F.col("new") + F.col("ahead")
        step = step.filter(F.col("node") != F.col("start")).filter(F.col("most").isNull() | (total <= F.col("most")))
        if bound:
            step = step.filter(F.col("new") < bound[1] if bound[0] == "<" else F.col("new") <= bound[1]).filter(total <= bound[1])
        offer = step.groupBy("start", "node").agg(F.min(F.struct(F.col("new").alias("cost"), "pcost", "layer", "pred", "rel")).alias("o"))
        old = best.select("start", "node", F.struct("cost", "pcost", "layer", "pred", "rel").alias("b"))
        met = offer.join(merged(old), ["start", "node"], "left").filter(F.col("b").isNull() | (F.col("o") < F.col("b")))
        moved = F.col("b").isNull() | (F.col("o.cost") < F.col("b.cost")) | (F.col("o.layer") != F.col("b.layer"))
        better = staged(met.select("start", "node", "o.*", moved.alias("moved")), "better")
        if better.isEmpty():
            break
        rounds += 1
        layers.append(better.select(*record))
        if len(layers) > LAYERS:
            layers = [staged(_least(layers), "best")]
        frontier = better.filter("moved")
    return _traced(_least(layers), goals, rounds)


def _least(layers: list[DataFrame]) -> DataFrame:
    """The best record of each start and node among all layers."""
    if len(layers) == 1:
        return layers[0]
    out = layers[0]
    for x in layers[1:]:
        out = out.unionAll(x)
    least = F.min(F.struct("cost", "pcost", "layer", "pred", "rel")).alias("b")
    return out.groupBy("start", "node").agg(least).select("start", "node", "b.*")


def _traced(best: DataFrame, goals: DataFrame, rounds: int) -> DataFrame:
    """Routes read back from their goals, one edge for all starts at a time; none has more edges than there were rounds."""
    best = staged(best, "best")
    end = best.join(merged(goals), "node").groupBy("start").agg(F.min(F.struct("cost", (F.col("node") != F.col("start")).alias("away"), "node")).alias("g"))
    cursor = end.select("start", F.col("g.node").alias("goal"), F.col("g.cost").alias("cost"), F.col("g.node").alias("node"), F.array("g.node").alias("nodes"), F.array().cast("array<bigint>").alias("rels"))
    back = best.filter("node <> start").select("start", "node", "pred", "rel")
    for i in range(rounds):
        onward = F.col("pred").isNotNull()  # what has come to its start stays as it is
        cursor = cursor.join(merged(back), ["start", "node"], "left").select("start", "goal", "cost", F.coalesce("pred", "node").alias("node"), F.when(onward, F.concat(F.array("pred"), "nodes")).otherwise(F.col("nodes")).alias("nodes"), F.when(onward, F.concat(F.array("rel"), "rels")).otherwise(F.col("rels")).alias("rels"))
        if i % 8 == 7:
            cursor = staged(cursor, "route")
            if cursor.filter("node <> start").isEmpty():
                break
    return cursor.select("start", "goal", "cost", F.size("rels").cast("long").alias("hops"), "nodes", "rels")

"""How near and by what way nodes are tied to starts, over two kinds of relationship.

The first kind leads from a start to the nodes that it names (one hop), the
second joins those with each other.  All starts advance together; a node
counts once for each start, at its least number of hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .walks import reach

DEGREE_MOST = 64  # links of a node whose surroundings are laid out as one row
NAMED_MOST = 10_000  # nodes of a start that are gathered as one row


def both_ways(links: DataFrame) -> DataFrame:
    """``src, dst`` of ``links`` in either direction, once each."""
    links = links.select("src", "dst")
    return links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _most(rows: DataFrame, key: str) -> int:
    """The most rows of one ``key``."""
    return rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def proximity(named: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """``start, node, hops`` of all nodes at most ``most`` hops from a start.

    ``named`` (start, node) are the nodes of one hop; ``links`` (src, dst) are
    followed both ways.  Up to three hops, what lies around a node is laid out
    once and sent to the starts that name it, one row for each of those;
    nodes of more than DEGREE_MOST links and starts of more than NAMED_MOST
    nodes have all walk level by level.
    """
    named = named.select("start", "node")
    if most < 2:
        return named.distinct().withColumn("hops", F.lit(1))
    both = staged(both_ways(links), "links")
    if most <= 3 and _most(both, "src") <= DEGREE_MOST and _most(named, "start") <= NAMED_MOST:
        return _around(named, both, most)
    named = named.distinct()
    further = reach(named, both.withColumn("rel_id", F.lit(0).cast("long")), 1, most - 1)
    return named.withColumn("hops", F.lit(1)).unionByName(further.select("start", "node", (F.col("depth") + 1).cast("int").alias("hops")))


def _around(named: DataFrame, both: DataFrame, most: int) -> DataFrame:
    """``start, node, hops`` by the balls of the named nodes; ids travel as 32-bit distances from the least where they fit."""
    ends = both.agg(F.min("src").alias("lo"), F.max("src").alias("hi")).first()
    lo = ends.lo or 0
    kind = "int" if (ends.hi or 0) - lo < 1 << 31 else "bigint"
    short = both.select("src", "dst", (F.col("dst") - lo).cast(kind).alias("x"))
    near = short.groupBy("src").agg(F.collect_list("x").alias("near"))
    ball = near.withColumn("far", F.array().cast(f"array<{kind}>"))
    if most > 2:
        beyond = near.select(F.col("src").alias("dst"), F.col("near").alias("beyond"))
        ball = short.join(beyond, "dst").groupBy("src").agg(F.collect_list("x").alias("near"), F.flatten(F.collect_list("beyond")).alias("far"))
        own = F.array((F.col("src") - lo).cast(kind))
        ball = ball.select("src", "near", F.array_except("far", F.concat("near", own)).alias("far"))
    sent = named.join(ball, named["node"] == ball["src"], "left").select("start", F.struct("node", "near", "far").alias("x"))
    met = sent.repartition("start").groupBy("start").agg(F.collect_list("x").alias("x"))
    long_ = lambda c: F.transform(F.flatten(F.filter(c, lambda x: x.isNotNull())), lambda x: x.cast("long") + lo)
    met = met.select("start", F.array_distinct("x.node").alias("one"), long_("x.near").alias("two"), long_("x.far").alias("three"))
    met = met.select("start", "one", F.array_except("two", "one").alias("two"), "three")
    met = met.select("start", "one", "two", F.array_except("three", F.concat("one", "two")).alias("three"))
    levels = [F.struct(F.lit(i + 1).alias("hops"), F.col(c).alias("nodes")) for i, c in enumerate(("one", "two", "three")[:most])]
    return met.select("start", F.explode(F.array(*levels)).alias("x")).select("start", "x.hops", F.explode("x.nodes").alias("node")).select("start", "node", "hops")


def connections(asked: DataFrame, named: DataFrame, links: DataFrame, official: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``start, node, way, prefix, nodes``: how each pair of ``asked`` (start, node) is tied.

    ``way`` is ``named`` where the start names the node, ``official`` where
    ``asked.path`` begins with a prefix of the start in ``official`` (start,
    prefix; the longest counts, letters in any case, a final ``*`` aside),
    ``linked`` where links (followed from src to dst, at most ``most`` of
    them) lead there from a named node, and ``none`` otherwise.  ``nodes`` is
    the route: among routes of fewest links, every node has the predecessor of
    least id.
    """
    asked = staged(asked.distinct(), "asked")
    pairs = asked.select("start", "node").distinct()
    if most is not None and most <= 2:
        edges = staged(links.select("src", "dst").distinct(), "links")
        if _most(edges, "dst") <= DEGREE_MOST and _most(named, "start") <= NAMED_MOST:
            out = _tied(pairs, named.select("start", "node"), edges, most)
            out = out.join(_owned(asked, official), ["start", "node"], "left") if official is not None and "path" in asked.columns else out.withColumn("prefix", F.lit(None).cast("string"))
            prefix = F.when(~F.col("direct"), F.col("prefix"))
            way = F.when(F.col("direct"), "named").when(F.col("prefix").isNotNull(), "official").when(F.col("nodes").isNotNull(), "linked").otherwise("none")
            nodes = F.when(F.col("direct") | F.col("prefix").isNotNull(), F.array("node")).otherwise(F.col("nodes"))
            return out.select("start", "node", way.alias("way"), prefix.alias("prefix"), nodes.alias("nodes"))
    named = named.select("start", "node").distinct().join(pairs.select("start").distinct(), "start", "left_semi")
    named = staged(named, "named")
    direct = staged(pairs.join(named, ["start", "node"], "left_semi"), "direct")
    owned = pairs.limit(0).withColumn("prefix", F.lit(None).cast("string"))
    if official is not None and "path" in asked.columns:
        owned = _owned(asked.join(direct, ["start", "node"], "left_anti"), official)
    owned = staged(owned, "owned")
    left = pairs.join(direct, ["start", "node"], "left_anti").join(owned, ["start", "node"], "left_anti")
    traced = staged(_linked(staged(left, "left"), named, links, most), "traced")
    out = pairs.join(direct.withColumn("direct", F.lit(True)), ["start", "node"], "left")
    out = out.join(owned, ["start", "node"], "left").join(traced, ["start", "node"], "left")
    way = F.when(F.col("direct"), "named").when(F.col("prefix").isNotNull(), "official").when(F.col("nodes").isNotNull(), "linked").otherwise("none")
    nodes = F.when(F.col("direct") | F.col("prefix").isNotNull(), F.array("node")).otherwise(F.col("nodes"))
    return out.select("start", "node", way.alias("way"), "prefix", nodes.alias("nodes"))


def _owned(asked: DataFrame, official: DataFrame) -> DataFrame:
    """``start, node, prefix``: the longest official prefix with which a path begins."""
    prefix = F.regexp_replace(F.lower("prefix"), r"\*$", "")
    known = official.select("start", prefix.alias("prefix")).filter("prefix <> ''")
    met = asked.join(known, "start").filter(F.startswith(F.lower("path"), F.col("prefix")))
    longest = F.max(F.struct(F.length("prefix").alias("n"), "prefix")).alias("p")
    return met.groupBy("start", "node").agg(longest).select("start", "node", "p.prefix")


def _tied(pairs: DataFrame, named: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``start, node, direct, nodes`` of ``pairs`` over at most two links, looked up backwards.

    What leads to an asked node in one and two links is laid out once for each
    node and met by all that its start names, one row for each pair and name.
    """
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.collect_list("src").alias("ins"))
    ball = edges.join(into, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.collect_list(F.struct(F.col("src").alias("b"), "ins")).alias("ball"))
    pairs = pairs.join(ball, "node", "left").select("start", F.lit(None).cast("long").alias("n"), F.struct("node", "ball").alias("asked"))
    held = named.filter("start is not null and node is not null").select("start", F.col("node").alias("n")).withColumn("asked", F.lit(None).cast(pairs.schema["asked"].dataType))
    met = pairs.unionByName(held).repartition("start").groupBy("start").agg(F.collect_list("n").alias("named"), F.collect_list("asked").alias("asked"))
    met = met.select("start", "named", F.explode("asked").alias("x")).select("start", "named", "x.node", "x.ball")
    least = lambda xs: F.array_min(F.array_intersect(xs, F.col("named")))
    two = F.array_min(F.filter(F.transform("ball", lambda x: F.struct(x.b.alias("b"), least(x.ins).alias("c"))), lambda y: y.c.isNotNull()))
    met = met.select("start", "node", F.coalesce(F.array_contains("named", F.col("node")), F.lit(False)).alias("direct"), least(F.col("ball.b")).alias("one"), two.alias("two"))
    nodes = F.when(F.col("direct") | F.lit(most < 1), None).when(F.col("one").isNotNull(), F.array("one", "node"))
    if most > 1:
        nodes = nodes.when(F.col("two").isNotNull(), F.array("two.c", "two.b", "node"))
    return met.select("start", "node", "direct", nodes.alias("nodes"))


def _linked(asked: DataFrame, named: DataFrame, links: DataFrame, most: int | None) -> DataFrame:
    """``start, node, nodes`` of those of ``asked`` that links lead to.

    A start whose pairs are all found walks no further.
    """
    edges = links.select("src", "dst").distinct()
    frontier = named.join(asked.select("start").distinct(), "start", "left_semi")
    levels = [staged(frontier.withColumn("pred", F.lit(None).cast("long")).withColumn("depth", F.lit(0)), "level")]
    open_, depth = asked, 0
    while most is None or depth < most:
        depth += 1
        going = levels[-1].join(open_.select("start").distinct(), "start", "left_semi")
        step = going.join(edges, going["node"] == edges["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        for earlier in levels:
            step = step.join(earlier.select("start", "node"), ["start", "node"], "left_anti")
        step = staged(step.withColumn("depth", F.lit(depth)), "level")
        if step.isEmpty():
            break
        levels.append(step)
        open_ = staged(open_.join(step.select("start", "node"), ["start", "node"], "left_anti"), "open")
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    cursor = every.join(asked, ["start", "node"]).select("start", "node", F.col("pred").alias("at"), "depth", F.array("node").alias("nodes"))
    for d in range(len(levels) - 1, 0, -1):  # a route of d links takes its next step back among those of d - 1
        here = levels[d - 1].select("start", F.col("node").alias("at"), F.col("pred").alias("before"))
        back = cursor.filter(F.col("depth") >= d).join(here, ["start", "at"])
        back = back.select("start", "node", F.col("before").alias("at"), "depth", F.concat(F.array("at"), "nodes").alias("nodes"))
        cursor = cursor.filter(F.col("depth") < d).unionByName(back)
        if d % 4 == 0:
            cursor = staged(cursor, "route")
    return cursor.select("start", "node", "nodes")

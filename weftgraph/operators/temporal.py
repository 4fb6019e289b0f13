"""Valid time: values at instants, recorded boundaries, windows and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_points(points: DataFrame, changes: DataFrame) -> DataFrame:
    """``id, t, has, then``: the last change at or before each point (id, t).

    ``has`` says that the node has any history; ``then`` is null before its
    first entry.  Points and changes are sorted together by node, so the work
    is linear in both; no point meets more than one change.  A history has one
    entry for an instant (writes replace, loads keep the last).
    """
    value = changes.schema["value"].dataType
    a = changes.select("id", F.col("at").alias("t"), F.lit(0).alias("tag"), F.struct("value").alias("v"))
    b = points.select("id", "t").distinct().select("id", "t", F.lit(1).alias("tag"), F.lit(None).cast(a.schema["v"].dataType).alias("v"))
    w = Window.partitionBy("id").orderBy("t", "tag")
    both = a.unionAll(b).withColumn("last", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("has", F.min("tag").over(Window.partitionBy("id")) == 0)
    return both.filter("tag = 1").select("id", "t", "has", F.col("last.value").cast(value).alias("then"))


def own_boundaries(graph, name: str, fields) -> DataFrame:
    """``id, t``: instants at which a node's own ``fields`` or lifetime change, while it is visible."""
    kind = graph.schema.type(name)
    parts = [graph.changes(name, f).select("id", F.col("at").alias("t")) for f in fields if (name, f) in graph.history]
    for f in (kind.appears, kind.ends):
        if f:
            parts.append(graph.node(name).select("id", F.col(f).alias("t")).filter("t is not null"))
    if not parts:
        return graph.node(name).select("id", F.lit(None).cast("timestamp").alias("t")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return _seen(graph, name, out.distinct())


def _seen(graph, name: str, points: DataFrame) -> DataFrame:
    """The points at which the node is visible."""
    kind = graph.schema.type(name)
    if not (kind.appears or kind.ends):
        return points
    bounds = graph.node(name).select("id", *[F.col(f) for f in dict.fromkeys(x for x in (kind.appears, kind.ends) if x)])
    return graph.visible(name, points.join(bounds, "id"), F.col("t")).select("id", "t")


def all_boundaries(graph, types=None, kinds=None) -> DataFrame:
    """``t``: every instant at which anything that a test over ``types`` and ``kinds`` can see changes."""
    parts = [graph.changes(a, f).select(F.col("at").alias("t")) for a, f in graph.history if types is None or a in types]
    for name, kind in graph.schema.types.items():
        if types is None or name in types:
            parts += [graph.node(name).select(F.col(f).alias("t")) for f in (kind.appears, kind.ends) if f]
    for k in graph.intervals:
        if kinds is None or k in kinds:
            df = graph.interval(k)
            parts += [df.select(F.col("valid_from").alias("t")), df.select(F.col("valid_to").alias("t"))]
    if not parts:
        return graph.spark.createDataFrame([], "t timestamp")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.filter("t is not null").distinct()


def window_points(points: DataFrame, everyone: DataFrame, start, stop) -> DataFrame:
    """Boundaries (id, t) strictly inside a window, with both of its ends for every id of ``everyone``."""
    inside = points.filter((F.col("t") > start) & (F.col("t") < stop))
    ends = everyone.select("id", F.explode(F.array(start, stop)).alias("t"))
    return inside.unionAll(ends).distinct()


def states(graph, name: str, points: DataFrame, fields) -> DataFrame:
    """The rows of a type at each of their points (id, t); temporal ``fields`` as of then."""
    df = points.join(graph.node(name), "id")
    for f in fields:
        if (name, f) in graph.history:
            found = as_of_points(points, graph.changes(name, f))
            df = df.join(found, ["id", "t"], "left").withColumn(f, F.when(F.col("has"), F.col("then")).otherwise(F.col(f))).drop("has", "then")
    return df


def series(graph, name: str, fld: str, ids: DataFrame, instants: list[int]) -> DataFrame:
    """``id, t, value`` of a time-varying field at the sampled instants; null without history."""
    from ..functions import dates

    at = F.explode(F.array(*[dates.instant(s) for s in instants])) if instants else F.explode(F.array().cast("array<timestamp>"))
    points = ids.select("id").distinct().select("id", at.alias("t"))
    found = as_of_points(points, graph.changes(name, fld))
    return found.select("id", "t", F.when(F.col("has"), F.col("then")).alias("value"))


def summary(changes: DataFrame) -> DataFrame:
    """``id, low, high, first_at, last_at, first_value, last_value, n`` of each history."""
    return changes.groupBy("id").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min_by("value", "at").alias("first_value"),
        F.max_by("value", "at").alias("last_value"),
        F.count(F.lit(1)).alias("n"),
    )

"""Checks of a graph's data as frames of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..plans.errors import QueryError
from ..sources.graph import Graph


def unique_violations(df: DataFrame, field: str) -> DataFrame:
    """``value, n``: values that more than one node has (null never collides)."""
    return df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def single_violations(rel: DataFrame, end: str) -> DataFrame:
    """``id, n``: nodes with more than one relationship at ``end`` (src or dst)."""
    return rel.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(df: DataFrame, fields) -> DataFrame:
    """Rows that lack a required field, with its name in ``missing``."""
    needed = [f for f in fields if not f.optional]
    if not needed:
        return df.filter(F.lit(False)).withColumn("missing", F.lit(""))
    first = F.coalesce(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in needed])
    return df.withColumn("missing", first).filter(F.col("missing").isNotNull())


def ill_formed(df: DataFrame, fields) -> DataFrame:
    """Rows with a value outside its field's domain, the field's name in ``bad``."""
    tests = []
    for f in fields:
        c = F.col(f.name)
        if f.many:
            continue
        if f.base == "String" and f.unit:
            tests.append((f.name, values.valid_string(c, f.unit)))
        elif f.base == "Reference":
            tests.append((f.name, values.valid_string(c, "reference")))
        elif f.base == "Point":
            tests.append((f.name, F.coalesce(c.lat.between(-90, 90) & c.lon.between(-180, 180), c.isNull())))
        elif f.base == "Vector":
            finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            tests.append((f.name, F.coalesce((F.size(c) == f.dim) & finite, c.isNull())))
    if not tests:
        return df.filter(F.lit(False)).withColumn("bad", F.lit(""))
    first = F.coalesce(*[F.when(~ok, F.lit(n)) for n, ok in tests])
    return df.withColumn("bad", first).filter(F.col("bad").isNotNull())


def check_unique(graph: Graph, names, source: str = "", at=None) -> None:
    """Raise if a unique field of one of ``names`` has a repeated value."""
    for t, f in graph.schema.unique:
        if t in names and unique_violations(graph.node(t), f).limit(1).collect():
            raise QueryError(f"unique {t} {{ {f} }} is already used", source, at, f"two {t} would share one {f}")


def report(graph: Graph) -> DataFrame:
    """``check, subject, violations`` for every rule of the schema; one row for each rule."""
    out = []
    for t, f in graph.schema.unique:
        out.append(unique_violations(graph.node(t), f).agg(F.count(F.lit(1)).alias("violations")).select(F.lit("unique").alias("check"), F.lit(f"{t}.{f}").alias("subject"), "violations"))
    for name, t in graph.schema.types.items():
        fields = list(t.fields.values())
        out.append(missing(graph.node(name), fields).agg(F.count(F.lit(1)).alias("violations")).select(F.lit("required").alias("check"), F.lit(name).alias("subject"), "violations"))
        out.append(ill_formed(graph.node(name), fields).agg(F.count(F.lit(1)).alias("violations")).select(F.lit("domain").alias("check"), F.lit(name).alias("subject"), "violations"))
        for e in t.edges.values():
            if not e.many and not e.temporal:
                end = "src" if e.out else "dst"
                out.append(single_violations(graph.rel(e.kind), end).agg(F.count(F.lit(1)).alias("violations")).select(F.lit("single").alias("check"), F.lit(f"{name}.{e.name}").alias("subject"), "violations"))
    frame = out[0]
    for f in out[1:]:
        frame = frame.unionAll(f)
    return frame

"""Whole graphs from JSON lines: one node or relationship on each line.

Nodes come before the relationships that use them.  The lines are checked as
sets; the first offending line (by its number) is reported and nothing is
loaded.  Required fields and types are not checked; values convert to the
declared types.  Blank lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..plans.errors import QueryError
from ..plans.schema import Field, Schema
from .graph import Graph
from .staging import staged

LINE = "type string, id bigint, labels array<string>, props string, kind string, `from` bigint, `to` bigint"
KEYS = {"node": ("type", "id", "labels", "props"), "rel": ("type", "id", "kind", "from", "to", "props")}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: lines with their numbers from 1, in file order.

    Line numbers need the sizes of the partitions before; Spark's own counted
    index does that without gathering lines.
    """
    rows = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1] + 1, x[0]))
    return spark.createDataFrame(rows, "line bigint, value string")


def _value(props: F.Column, f: Field) -> F.Column:
    """A declared field out of the properties' JSON text."""
    raw = F.get_json_object(props, f"$['{f.name}']")
    if f.base == "Date" and not f.many:
        return dates.dated(raw)
    if f.many or f.base in ("Point", "Vector"):
        return F.from_json(raw, f.spark)
    return raw if f.base in ("String", "Reference") else raw.try_cast(f.spark)


def _refuse(bad: DataFrame) -> None:
    """Raise for the first bad line (line, why)."""
    first = bad.orderBy("line").limit(1).collect()
    if first:
        raise QueryError(f"invalid JSON-lines graph: {first[0].why} (line {first[0].line})")


def read(spark: SparkSession, path: str, schema: Schema) -> Graph:
    """A new graph from a file of lines; it replaces a graph as a whole."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    parsed = lines.select("line", "value", keys.alias("keys"), F.from_json("value", LINE).alias("x"))
    allowed = F.when(F.col("x.type") == "node", F.array(*[F.lit(k) for k in KEYS["node"]])).otherwise(F.array(*[F.lit(k) for k in KEYS["rel"]]))
    why = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.coalesce(~F.col("x.type").isin("node", "rel"), F.lit(True)), "the type is node or rel")
        .when(F.size(F.array_except("keys", allowed)) > 0, F.concat(F.lit("unknown field "), F.get(F.array_except("keys", allowed), F.lit(0))))
        .when((F.col("x.type") == "node") & F.coalesce(F.size("x.labels") < 1, F.lit(True)), "a node has labels")
        .when((F.col("x.type") == "node") & (F.size("x.labels") != F.size(F.array_distinct("x.labels"))), "a label is repeated")
        .when((F.col("x.type") == "rel") & (F.col("x.kind").isNull() | F.col("x.from").isNull() | F.col("x.to").isNull()), "a relationship has kind, from and to")
    )
    parsed = staged(parsed.select("line", "x.*", why.alias("why")), "lines")
    _refuse(parsed.filter(F.col("why").isNotNull()))
    nodes = _ids(parsed.filter("type = 'node'"), "id")
    rels = _ids(parsed.filter("type = 'rel'"), "id")
    for df, what in ((nodes, "node"), (rels, "relationship")):
        twice = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line")).filter("n > 1")
        _refuse(twice.select("line", F.concat(F.lit(f"{what} id "), F.col("id").cast("string"), F.lit(" is used twice")).alias("why")))
    known = nodes.select("id", F.col("line").alias("at"))
    for end in ("from", "to"):
        met = rels.select("line", F.col(end).alias("id")).join(known, "id", "left").filter(F.col("at").isNull() | (F.col("at") > F.col("line")))
        _refuse(met.select("line", F.concat(F.lit(f"no earlier line defines {end} "), F.col("id").cast("string")).alias("why")))
    labels = [r[0] for r in nodes.select(F.explode("labels")).distinct().limit(len(schema.types) + 1).collect()]
    for label in labels:
        schema.type(label)
    frames = {}
    for name, t in schema.types.items():
        mine = nodes.filter(F.array_contains("labels", name))
        frames[name] = mine.select("id", *[_value(F.col("props"), f).cast(f.spark).alias(f.name) for f in t.fields.values()])
    kinds = {}
    for kind in schema.kinds():
        fields = schema.props_of(kind).values()
        kinds[kind] = rels.filter(F.col("kind") == kind).select(F.col("id").alias("rel_id"), F.col("from").alias("src"), F.col("to").alias("dst"), *[_value(F.col("props"), f).cast(f.spark).alias(f.name) for f in fields])
    several = nodes.filter(F.size("labels") > 1).limit(1).count() > 0
    graph = Graph(spark, schema, frames, kinds, multi_label=several)
    from ..writes.validate import check_unique

    check_unique(graph, set(schema.types))
    return graph


def _ids(df: DataFrame, name: str) -> DataFrame:
    """Rows without an id get the next one after the highest on any earlier line.

    Running maxima and counts are taken within ranges of lines and carried
    over from the ranges before, of which there are few; no task sees all rows.
    """
    from pyspark.sql import Window

    if not df.filter(F.col(name).isNull()).limit(1).count():
        return df
    dealt = staged(df.select("line", F.col(name).alias("given")).repartitionByRange("line").withColumn("part", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy("part").orderBy("line")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    zero = F.lit(0).cast("long")
    parts = dealt.groupBy("part").agg(F.max("given").alias("top"), F.sum(F.col("given").isNull().cast("long")).alias("gaps"))
    parts = parts.select("part", F.coalesce(F.max("top").over(earlier), zero).alias("top0"), F.coalesce(F.sum("gaps").over(earlier), zero).alias("gaps0"))
    rows = dealt.join(F.broadcast(parts), "part")
    rows = rows.withColumn("most", F.greatest("top0", F.coalesce(F.max("given").over(so_far), zero)))
    rows = rows.withColumn("gaps", F.col("gaps0") + F.sum(F.col("given").isNull().cast("long")).over(so_far))
    # where a new maximum comes, rows without id count anew from there
    rows = rows.withColumn("mark", F.when(F.col("given") > F.coalesce(F.lag("most").over(inside), F.col("top0")), F.col("gaps")))
    marks = rows.groupBy("part").agg(F.max("mark").alias("last"))
    marks = marks.select("part", F.coalesce(F.max("last").over(earlier), zero).alias("mark0"))
    rows = rows.join(F.broadcast(marks), "part").withColumn("base", F.coalesce(F.max("mark").over(so_far), F.col("mark0")))
    numbers = rows.select("line", F.coalesce("given", F.col("most") + F.col("gaps") - F.col("base")).alias("_given"))
    return df.join(numbers, "line").withColumn(name, F.col("_given")).drop("_given")

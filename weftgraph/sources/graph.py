"""A property graph as DataFrames: one per node type and relationship kind.

``nodes[type]`` has ``id`` and the declared fields; ``rels[kind]`` has
``rel_id, src, dst`` and the kind's properties; ``history[type, field]`` has
``id, at, value`` of a time-varying field; ``intervals[kind]`` has the
half-open validity ``[valid_from, valid_to)`` of a time-typed relationship.
A graph never changes: each write returns another.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..plans.schema import Schema
from .staging import empty


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    schema: Schema
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, DataFrame] = field(default_factory=dict)
    history: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    intervals: dict[str, DataFrame] = field(default_factory=dict)
    multi_label: bool = False  # a node may be in several types' frames
    dated: bool = False  # a view at one instant or at several
    unrolled: int = 0  # ids are id * unrolled + number of an instant
    next_id: int | None = None  # known after a first write
    next_rel: int | None = None

    # --- frames -----------------------------------------------------------

    def node(self, name: str) -> DataFrame:
        """``id`` and the fields of a type, whatever columns the frame has."""
        kind = self.schema.type(name)
        if name not in self.nodes:
            return empty(self.spark, kind.columns())
        df = self.nodes[name]
        have = set(df.columns)
        return df.select("id", *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.spark).alias(f.name) for f in kind.fields.values()])

    def nodes_of(self, names: tuple[str, ...]) -> DataFrame:
        """Several types in one frame with ``_type``; absent fields are null."""
        frames = [self.node(n).withColumn("_type", F.lit(n)) for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out.dropDuplicates(["id"]) if len(frames) > 1 and self.multi_label else out

    def rel(self, kind: str) -> DataFrame:
        schema = self.schema.rel_columns(kind)
        if kind not in self.rels:
            return empty(self.spark, schema)
        df = self.rels[kind]
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def interval(self, kind: str) -> DataFrame:
        schema = T.StructType([*self.schema.rel_columns(kind), T.StructField("valid_from", T.TimestampType()), T.StructField("valid_to", T.TimestampType())])
        return self.intervals[kind].select(*[F.col(c).cast(schema[c].dataType) for c in schema.names]) if kind in self.intervals else empty(self.spark, schema)

    def changes(self, name: str, fld: str) -> DataFrame:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("value", self.schema.type(name).fields[fld].spark)])
        return self.history[name, fld].select(*[F.col(c).cast(schema[c].dataType) for c in schema.names]) if (name, fld) in self.history else empty(self.spark, schema)

    def adjacency(self, source: str, edge_name: str) -> DataFrame:
        """``src, dst, rel_id`` and properties (``&name``), from the type that declares the edge."""
        e = self.schema.type(source).edges[edge_name]
        df = self.rel(e.kind)
        a, b = ("src", "dst") if e.out else ("dst", "src")
        return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), "rel_id", *[F.col(p).alias(f"&{p}") for p in e.props])

    # --- totals -----------------------------------------------------------

    def counts(self) -> dict[str, int]:
        """Numbers of nodes and relationships, one job for each side."""

        def total(frames, key):
            frames = [f.select(key) for f in frames]
            if not frames:
                return 0
            out = frames[0]
            for f in frames[1:]:
                out = out.unionAll(f)
            return (out.distinct() if self.multi_label and key == "id" else out).count()

        return {"nodes": total(self.nodes.values(), "id"), "relationships": total(self.rels.values(), "rel_id")}

    def free_ids(self) -> tuple[int, int]:
        """The first unused node and relationship ids, at least 1."""
        if self.next_id is not None and self.next_rel is not None:
            return self.next_id, self.next_rel
        tops = []
        for frames, key in ((self.nodes, "id"), ({**self.rels, **{f"{k} over time": v for k, v in self.intervals.items()}}, "rel_id")):
            most = [f.agg(F.max(key)).first()[0] for f in frames.values()]
            tops.append(max([0, *(m for m in most if m is not None)]) + 1)
        return tops[0], tops[1]

    # --- time -------------------------------------------------------------

    def visible(self, name: str, df: DataFrame, t) -> DataFrame:
        """Rows of a type's frame whose lifetime holds the instant ``t``."""
        kind = self.schema.type(name)
        if kind.appears:
            df = df.filter(F.col(kind.appears).isNull() | (F.col(kind.appears) <= t))
        if kind.ends:
            df = df.filter(F.col(kind.ends).isNull() | (F.col(kind.ends) > t))
        return df

    def at(self, seconds: int) -> Graph:
        """The graph as of one instant."""
        t = dates.instant(seconds)
        nodes = {}
        for name in self.schema.types:
            df = self.visible(name, self.node(name), t)
            for (owner, f), _ in self.history.items():
                if owner != name:
                    continue
                past = F.max(F.when(F.col("at") <= t, F.struct("at", "value")))
                then = self.changes(name, f).groupBy("id").agg(past.alias("_then")).withColumn("_has", F.lit(True))
                df = df.join(then, "id", "left").withColumn(f, F.when(F.col("_has"), F.col("_then.value")).otherwise(F.col(f))).drop("_then", "_has")
            nodes[name] = df
        rels = {k: df for k, df in self.rels.items() if k not in self.intervals}
        for kind in self.intervals:
            held = (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))
            rels[kind] = self.interval(kind).filter(held).drop("valid_from", "valid_to")
        return replace(self, nodes=nodes, rels=rels, dated=True)

    def at_each(self, instants: DataFrame, most: int) -> Graph:
        """The graph at each of ``instants`` (k, t) side by side; ids are ``id * most + k``.

        A node's states meet only edges of the same instant, so any plan over
        the result evaluates every instant at once.
        """
        from ..operators.temporal import as_of_points

        instants = F.broadcast(instants)
        code = lambda c: F.col(c) * most + F.col("_k")
        nodes = {}
        for name in self.schema.types:
            df = self.node(name).crossJoin(instants.select(F.col("k").alias("_k"), F.col("t").alias("_t")))
            df = self.visible(name, df, F.col("_t"))
            for (owner, f), _ in self.history.items():
                if owner == name:
                    found = as_of_points(df.select("id", F.col("_t").alias("t")), self.changes(name, f))
                    df = df.join(found.select("id", F.col("t").alias("_t"), "has", "then"), ["id", "_t"], "left")
                    df = df.withColumn(f, F.when(F.col("has"), F.col("then")).otherwise(F.col(f))).drop("has", "then")
            nodes[name] = df.withColumn("id", code("id")).drop("_k", "_t")
        rels = {}
        for kind in {*self.rels, *self.intervals}:
            if kind in self.intervals:
                df = self.interval(kind)
                held = (F.col("valid_from") <= F.col("_t")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_t")))
            else:
                df, held = self.rel(kind), F.lit(True)
            df = df.crossJoin(instants.select(F.col("k").alias("_k"), F.col("t").alias("_t"))).filter(held)
            rels[kind] = df.withColumn("src", code("src")).withColumn("dst", code("dst")).select(*self.schema.rel_columns(kind).names)
        return replace(self, nodes=nodes, rels=rels, history={}, intervals={}, dated=True, unrolled=most)

    def live_from_history(self) -> Graph:
        """Live values recomputed as the latest entries in valid time (late backfills change nothing else)."""
        nodes = dict(self.nodes)
        for (name, f), _ in self.history.items():
            last = self.changes(name, f).groupBy("id").agg(F.max(F.struct("at", "value")).alias("_last"))
            nodes[name] = self.node(name).join(last, "id", "left").withColumn(f, F.when(F.col("_last").isNotNull(), F.col("_last.value")).otherwise(F.col(f))).drop("_last")
        return replace(self, nodes=nodes)


# --- storage ----------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def save(graph: Graph, path: str) -> int:
    """Write a new version of the graph: Parquet per frame and a manifest.

    The manifest is renamed into its place last and the highest version that
    has one is current, so a reader sees the old version or the new one, never
    a mixture, at any moment and after a crash.  Returns the version.
    """
    spark = graph.spark
    version = max(_versions(spark, path, "v=*"), default=0) + 1
    base = f"{path}/v={version}"
    manifest = {"schema": graph.schema.written(), "nodes": sorted(graph.nodes), "rels": sorted(graph.rels), "history": sorted(f"{a}.{b}" for a, b in graph.history), "intervals": sorted(graph.intervals), "multi_label": graph.multi_label}
    for n in graph.nodes:
        graph.node(n).write.mode("overwrite").parquet(f"{base}/nodes/{n}")
    for k in graph.rels:
        graph.rel(k).write.mode("overwrite").parquet(f"{base}/rels/{k}")
    for a, b in graph.history:
        graph.changes(a, b).write.mode("overwrite").parquet(f"{base}/history/{a}.{b}")
    for k in graph.intervals:
        graph.interval(k).write.mode("overwrite").parquet(f"{base}/intervals/{k}")
    _put(spark, f"{base}/manifest.next", json.dumps(manifest, indent=1, sort_keys=True))
    p, fs = _hadoop(spark, f"{base}/manifest.json")
    if not fs.rename(_hadoop(spark, f"{base}/manifest.next")[0], p):
        raise OSError(f"version {version} of {path} was written by another at the same time")
    return version


def _versions(spark: SparkSession, path: str, shape: str) -> list[int]:
    """Numbers of the versions under ``path`` that have what ``shape`` names."""
    p, fs = _hadoop(spark, f"{path}/{shape}")
    return [int(part[2:]) for s in fs.globStatus(p) or [] for part in s.getPath().toString().split("/") if part.startswith("v=") and part[2:].isdigit()]


def load(spark: SparkSession, path: str, version: int | None = None) -> Graph:
    """The current (or a named) version of a saved graph."""
    from ..plans.parser import parse_schema

    if version is None:
        version = max(_versions(spark, path, "v=*/manifest.json"), default=0)
        if not version:
            raise FileNotFoundError(f"no graph at {path}")
    base = f"{path}/v={version}"
    m = json.loads(_get(spark, f"{base}/manifest.json"))
    read = lambda part, n: spark.read.parquet(f"{base}/{part}/{n}")
    return Graph(
        spark,
        parse_schema(m["schema"]),
        {n: read("nodes", n) for n in m["nodes"]},
        {k: read("rels", k) for k in m["rels"]},
        {tuple(x.split(".")): read("history", x) for x in m["history"]},
        {k: read("intervals", k) for k in m["intervals"]},
        m["multi_label"],
    )


# --- export -----------------------------------------------------------------


def _props_json(df: DataFrame, fields) -> F.Column:
    named = [(F.col(f"`{f.name}`") if f.base != "Date" else dates.dated_text(F.col(f"`{f.name}`"))).alias(f.name) for f in sorted(fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*named)) if named else F.lit("{}")


def export_nodes(graph: Graph) -> DataFrame:
    """``id, labels, props`` (JSON text) of every node."""
    frames = [graph.node(n).select("id", F.lit(n).alias("label"), _props_json(None, t.fields.values()).alias("props")) for n, t in graph.schema.types.items() if n in graph.nodes]
    if not frames:
        return empty(graph.spark, "id bigint, labels array<string>, props string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    if not graph.multi_label:
        return out.select("id", F.array("label").alias("labels"), "props")
    return out.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("props").alias("props"))


def export_rels(graph: Graph) -> DataFrame:
    """``id, type, from, to, props`` (JSON text) of every relationship."""
    frames = [graph.rel(k).select(F.col("rel_id").alias("id"), F.lit(k).alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), _props_json(None, graph.schema.props_of(k).values()).alias("props")) for k in sorted(graph.rels)]
    if not frames:
        return empty(graph.spark, "id bigint, type string, `from` bigint, `to` bigint, props string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def numbered(df: DataFrame, start: int, keys: list, name: str) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of ``keys``.

    Rows are range-partitioned, numbered within their partition and shifted by
    the sizes of the partitions before: no single task sees all rows.
    """
    from .staging import staged

    if not keys:
        raise ValueError("numbers need an order")
    dealt = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", "first", before.alias("before"))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.lit(start) + F.col("before") + F.col("_seq") - F.col("first")).drop("_part", "_seq", "first", "before")

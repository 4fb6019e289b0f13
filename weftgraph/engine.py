"""The engine: statements in, DataFrames and results out.

``Engine`` holds the current ``Graph``.  Reads give DataFrames (``flat`` or
``nested``) or plain Python values (``run``); writes replace the graph as a
whole or leave it as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .operators.walks import Work
from .plans import checker, periods
from .plans import syntax as X
from .plans.errors import QueryError
from .plans.lowering import Context, Lowering, changes_struct, root_error
from .plans.parser import Parser, parse_schema
from .plans.schema import Schema
from .plans.stages import EDGES, Found, Stages
from .sources.graph import Graph, export_nodes, export_rels
from .sources.staging import empty, staged


@dataclass
class StageResult:
    """One stage of a pipeline; edges are real, proposals are evidence.  Nodes and edges are made on first use."""

    index: int
    kind: str
    ends: Callable[[], tuple[DataFrame, DataFrame]]
    found: Found | None = None

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        return self.ends()

    @property
    def nodes(self) -> DataFrame:
        return self._both[0]

    @property
    def edges(self) -> DataFrame:
        return self._both[1]

    @property
    def proposals(self) -> DataFrame | None:
        return self.found.edges if self.found else None


class Engine:
    def __init__(self, graph: Graph, budget: int | None = None, time_limit: float | None = None, counting: bool = False):
        self.graph, self.budget, self.time_limit, self.counting = graph, budget, time_limit, counting
        self.work = Work()  # of the last statement, if it was counted
        self.version = 0
        self.changes: list = []
        self.receipts: str | None = None  # the folder of receipts of deliveries

    @classmethod
    def empty(cls, spark: SparkSession, schema: str | Schema = "", **kw) -> Engine:
        found = parse_schema(schema) if isinstance(schema, str) else schema
        return cls(Graph(spark, found), **kw)

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark

    # --- statements -------------------------------------------------------

    def parse(self, text: str) -> X.Document:
        return Parser(text).document(self.graph.schema)

    def run(self, text: str, sources: dict[str, str] | None = None) -> Any:
        """Run one or more statements; the value of the last (a schema replaces the engine's own)."""
        doc = self.parse(text)
        if doc.schema is not None and doc.schema is not self.graph.schema:
            self.graph = replace(self.graph, schema=doc.schema)
        out = None
        for s in doc.statements:
            checker.check(self.graph.schema, s, text)
            out = self._write(s, text, sources) if isinstance(s, X.Mutation) else self._limited(lambda q=s: self._read(q, text))
        return out

    apply = run

    def _limited(self, work):
        """Run a read under the time limit: its jobs carry a tag that a timer interrupts."""
        if self.time_limit is None:
            return work()
        import threading
        import uuid

        tag, spark = f"weft-{uuid.uuid4().hex}", self.spark
        late = threading.Event()

        def stop():
            late.set()
            spark.interruptTag(tag)

        timer = threading.Timer(self.time_limit, stop)
        spark.addTag(tag)
        timer.start()
        try:
            return work()
        except Exception:
            if late.is_set():
                raise QueryError(f"the statement took longer than {self.time_limit} s") from None
            raise
        finally:
            timer.cancel()
            spark.removeTag(tag)

    def _query(self, text: str) -> X.Query:
        doc = self.parse(text)
        if len(doc.statements) != 1 or not isinstance(doc.statements[0], X.Query):
            raise QueryError("expected one query")
        checker.check(self.graph.schema, doc.statements[0], text)
        return doc.statements[0]

    def _work(self) -> Work | None:
        """A new count of what a statement reads, where a budget or the caller asks for one."""
        if self.budget is None and not self.counting:
            return None
        self.work = Work(self.budget)
        return self.work

    def _lowering(self, q: X.Query, text: str) -> Lowering:
        """The view that a query reads: now, or as of its date."""
        g, types = self.graph, q.root.types if q.root else ()
        samples: tuple[int, ...] = ()
        if q.series:
            a = periods.instant(g, types, q.series[0], False, text)
            b = periods.instant(g, types, q.series[1], True, text)
            if a > b:
                raise QueryError("a series starts after it ends")
            unit = q.series[2]
            samples = tuple(dates.samples(a, b, unit) if unit in ("day", "week", "month") else periods.overlapping(g, types, unit, a, b))
        view = g.at(periods.instant(g, types, q.as_of, False, text)) if q.as_of else g
        return Lowering(view, Context(text, samples, self._work(), g))

    # --- reads as DataFrames ----------------------------------------------

    def flat(self, text: str) -> DataFrame:
        """One row for each path through the selection, dotted names; unordered."""
        q = self._query(text)
        low = self._lowering(q, text)
        if q.window or q.root.window:
            df = low.windowed(q.root, q.root.window or q.window)
            return df.select("id", "out.*") if "out" in df.columns else df
        rows, _ = low.roots(q.root)
        df, names = low.flat(rows, q.root)
        return df.select(*[F.col(f"`={n}`").alias(n) for n in names])

    def nested(self, text: str) -> DataFrame:
        """One row for each root: the selected items, relationships as arrays of structs.

        Rows come in the order of the language: by the order keys, then by id.
        """
        q = self._query(text)
        return self._nested(q, text)[0]

    def _nested(self, q: X.Query, text: str, trace: bool = False):
        low = self._lowering(q, text)
        if trace:
            low.trace = []
        window = q.root.window or q.window
        if window:
            df = low.windowed(q.root, window)
            if window.changes:
                return changes_struct(df, []).select("out.*"), low
            return df.orderBy("id").select("out.*"), low
        rows, keys = low.roots(q.root)
        out = low.nested(rows, q.root)
        return out.orderBy(*keys, F.asc("id")).select("out.*"), low

    def _read(self, q: X.Query, text: str):
        if q.stages or q.skip:
            return self._stages_json(self._pipeline(q, text)) if q.stages else None
        if q.root is None:
            return None
        window = q.root.window or q.window
        df, _ = self._nested(q, text)
        if not window and q.root.says_one:
            rows = _rows(df.limit(2))
            if len(rows) > 1:
                raise root_error(q.root)
            return rows[0] if rows else None
        rows = _rows(df)
        if window and window.changes:
            return rows[0]
        return rows

    # --- discovery --------------------------------------------------------

    def pipeline(self, text: str) -> list[StageResult]:
        """The visible stages of a query with ``then`` blocks."""
        return self._pipeline(self._query(text), text)

    def _pipeline(self, q: X.Query, text: str) -> list[StageResult]:
        spark = self.spark
        if q.root is None:
            scope, traced = spark.createDataFrame([], "id bigint"), None
        else:
            _, low = self._nested(q, text, trace=True)
            ids, rels = [], []
            for df, columns in low.trace:
                ids.append(df.select("id"))
                if "_rel" in columns:
                    rels.append(df.select(F.col("_rel").alias("rel_id")).filter("rel_id is not null"))
            scope = staged(_union(ids).distinct(), "scope")
            traced = staged(_union(rels).distinct(), "traced") if rels else None
        out = [] if q.skip else [self._stage(0, "query", Found(scope, empty(spark, EDGES)), traced, False)]
        stages = Stages(self.graph if not q.as_of else self._lowering(q, text).graph)
        for i, stage in enumerate(q.stages):
            found = stages.run(found.nodes if i else scope, stage.condition)
            if not stage.skip:
                out.append(self._stage(i + 1, "then", found, traced))
        return out

    def _stage(self, index: int, kind: str, found: Found, traced: DataFrame | None, proposing: bool = True) -> StageResult:
        graph = self.graph

        def ends():
            nodes, edges = found.nodes, export_rels(graph)
            if traced is None:
                edges = edges.filter(F.lit(False))
            else:
                edges = edges.join(traced.withColumnRenamed("rel_id", "id"), "id", "left_semi")
                edges = edges.join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
            return export_nodes(graph).join(nodes, "id", "left_semi"), edges

        return StageResult(index, kind, ends, found if proposing else None)

    def _stages_json(self, stages: list[StageResult]) -> dict:
        out = []
        for s in stages:
            one = {"index": s.index, "kind": s.kind}
            one["nodes"] = [{"id": r.id, "labels": list(r.labels), "props": json.loads(r.props)} for r in s.nodes.orderBy("id").collect()]
            one["edges"] = [{"id": r["id"], "type": r["type"], "from": r["from"], "to": r["to"], "props": json.loads(r["props"])} for r in s.edges.orderBy("id").collect()]
            if s.proposals is not None:
                edges = []
                for r in s.proposals.collect():
                    via = {"primitive": r.primitive, "fields": list(r.fields)}
                    if r.primitive == "common":
                        via["value"] = json.loads(r.value)
                    else:
                        via["score" if r.primitive == "similar" else "distance"] = r.measure
                    edges.append({"from": r["from"], "to": r["to"], "via": via})
                one["couldBeEdges"] = sorted(edges, key=lambda e: (e["from"], e["to"], json.dumps(e["via"], sort_keys=True)))
            out.append(one)
        return {"stages": out}

    # --- writes -----------------------------------------------------------

    def _write(self, m: X.Mutation, text: str, sources=None):
        from .writes.mutate import Writer

        writer = Writer(self.graph, text, sources, self._work())
        out = writer.run(m)
        self._commit(writer.graph, writer.log)
        return out

    def _commit(self, graph: Graph, log) -> None:
        self.graph = graph
        self.version += 1
        self.changes.append((self.version, log))

    def _edit(self, change) -> None:
        from .writes.mutate import Writer

        writer = Writer(self.graph, "", None)
        change(writer)
        self._commit(writer.graph, writer.log)

    def delete_nodes(self, ids: DataFrame | list[int]) -> None:
        """Delete nodes by ``id`` with their relationships, many at once."""
        found = self.spark.createDataFrame([(i,) for i in ids], "id bigint") if isinstance(ids, list) else ids
        self._edit(lambda w: w.delete_nodes(found))

    def delete_relationships(self, kind: str, ids: DataFrame | list[int]) -> None:
        """Delete relationships of one kind by ``rel_id``, many at once."""
        found = self.spark.createDataFrame([(i,) for i in ids], "rel_id bigint") if isinstance(ids, list) else ids
        self._edit(lambda w: w.delete_relationships(kind, found))

    def connect(self, source: str, field: str, pairs: DataFrame | list[tuple[int, int]]) -> None:
        """Add ``source.field`` between each pair (``src``, ``dst``) of existing nodes."""
        found = self.spark.createDataFrame(pairs, "src bigint, dst bigint") if isinstance(pairs, list) else pairs
        self._edit(lambda w: w.connect_pairs(source, field, found))

    def transaction(self, statements: list[str]) -> list:
        """All statements or none."""
        before = (self.graph, self.version, list(self.changes))
        try:
            return [self.run(s) for s in statements]
        except Exception:
            self.graph, self.version, self.changes = before
            raise

    # --- the rest ---------------------------------------------------------

    def counts(self) -> dict[str, int]:
        return self.graph.counts()

    def export(self) -> dict:
        """``{nodes, rels}`` sorted by id, as plain values (for small graphs)."""
        g = self.graph
        return {
            "nodes": [{"id": r.id, "labels": list(r.labels), "props": json.loads(r.props)} for r in export_nodes(g).orderBy("id").collect()],
            "rels": [{"id": r["id"], "type": r["type"], "from": r["from"], "to": r["to"], "props": json.loads(r["props"])} for r in export_rels(g).orderBy("id").collect()],
        }

    def sql(self, query: str, args: list | dict | None = None) -> DataFrame:
        """SQL over the graph's frames (views named by type and kind) and the session's tables."""
        for n in self.graph.nodes:
            self.graph.node(n).createOrReplaceTempView(n)
        for k in self.graph.rels:
            self.graph.rel(k).createOrReplaceTempView(f"rel_{k}")
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def reset_schema(self, text: str, force: bool = False):
        """Replace the schema if the difference blocks nothing."""
        from .writes.diff import schema_diff

        new = parse_schema(text)
        report = schema_diff(self.graph, new)
        if not report.ok and not force:
            raise QueryError("the new schema does not fit the data: " + "; ".join(c.text for c in report.changes if c.severity == "Blocks"))
        self.graph = replace(self.graph, schema=new)
        return report


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def _plain(v):
    """Rows, dates and numbers as plain JSON values."""
    from pyspark.sql import Row

    if isinstance(v, Row):
        d = {k: _plain(x) for k, x in v.asDict().items()}
        return {} if list(d) == ["_"] else d
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def _rows(df: DataFrame) -> list[dict]:
    out = []
    for r in df.collect():
        d = _plain(r)
        out.append(d)
    return out

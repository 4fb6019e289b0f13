"""Discovery stages over the nodes and edges that a query projects.

A stage is two frames: ``nodes`` (id) and ``edges`` (from, to, primitive,
fields, value, measure).  ``&&`` keeps nodes of both sides and edges whose
ends both remain; ``||`` keeps either, without repetition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import no_negative_zero
from ..operators import discovery
from ..sources.graph import Graph
from ..sources.staging import empty, staged
from . import syntax as X

EDGES = "`from` bigint, `to` bigint, primitive string, fields array<string>, value string, measure double"


class Found:
    """Nodes and edges of a stage.

    Nodes may be a function, called on first use.  Without nodes, they are the
    ends of the edges, which are then written once for both; edges alone are
    not written, as pairs may be many more than nodes.
    """

    def __init__(self, nodes: DataFrame | Callable[[], DataFrame] | None, edges: DataFrame):
        self._nodes, self.edges = nodes, edges

    @cached_property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            self.edges = staged(self.edges, "proposals")
            return staged(self.edges.select(F.explode(F.array("from", "to")).alias("id")).distinct(), "found")
        return staged(self._nodes().distinct(), "found") if callable(self._nodes) else self._nodes


class Stages:
    def __init__(self, graph: Graph):
        self.graph, self.schema, self.spark = graph, graph.schema, graph.spark

    def run(self, nodes: DataFrame, c) -> Found:
        """One condition over a node set; proposals whose ends remain."""
        found = self.evaluate(staged(nodes.select("id").distinct(), "scope"), c)
        if isinstance(c, (X.Common, X.Similar, X.Close)):  # each pair once, both ends found
            return found
        nodes = staged(found.nodes.select("id").distinct(), "found")
        return Found(nodes, self._kept(found.edges, nodes).distinct())

    def _kept(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("id").alias("from")), nodes.select(F.col("id").alias("to"))
        return edges.join(a, "from", "left_semi").join(b, "to", "left_semi")

    def evaluate(self, scope: DataFrame, c) -> Found:
        if isinstance(c, (X.And, X.Or)):
            found = [self.evaluate(scope, p) for p in c.parts]
            nodes, edges = found[0].nodes, found[0].edges
            for f in found[1:]:
                nodes = nodes.join(f.nodes, "id", "left_semi") if isinstance(c, X.And) else nodes.unionAll(f.nodes).distinct()
                edges = edges.unionByName(f.edges)
            if isinstance(c, X.And):
                edges = self._kept(edges, nodes)
            return Found(nodes, edges.distinct())
        if isinstance(c, X.TextSearch):
            return Found(self.text(scope, c), empty(self.spark, EDGES))
        if isinstance(c, X.Close):
            return self.near(scope, c)
        return Found(None, self.common(scope, c) if isinstance(c, X.Common) else self.similar(scope, c))

    def _typed(self, scope: DataFrame, name: str) -> DataFrame:
        return self.graph.node(name).join(scope, "id", "left_semi")

    def _union(self, frames):
        frames = [f for f in frames if f is not None]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def text(self, scope: DataFrame, c: X.TextSearch) -> DataFrame:
        op = "findExact" if c.op == "findWithout" else c.op
        hits = []
        for name, t in self.schema.types.items():
            fields = [f.name for f in t.fields.values() if (f.name in c.fields if c.fields else f.plain_text)]
            if fields:
                df = self._typed(scope, name)
                hits.append(df.filter(discovery.text_matches(df, fields, op, c.needle)).select("id"))
        found = self._union(hits).distinct() if hits else scope.filter(F.lit(False))
        return scope.join(found, "id", "left_anti") if c.op == "findWithout" else found

    def common(self, scope: DataFrame, c: X.Common) -> DataFrame:
        names = sorted(f"{t}.{f}" for t, fields in c.groups for f in fields)
        rows = []
        for t, fields in c.groups:
            kind = self.schema.types[t]
            values = [no_negative_zero(F.col(f)) if kind.fields[f].base == "Float" and not kind.fields[f].many else F.col(f) for f in fields]
            df = self._typed(scope, t)
            for f in fields:
                df = df.filter(F.col(f).isNotNull())
            rows.append(df.select("id", F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]).alias("value")))
        edges = discovery.stars(self._union(rows).distinct())
        single = len(c.groups[0][1]) == 1
        parts = [F.to_json(F.array(F.col(f"value.v{i}"))) for i in range(len(c.groups[0][1]))]
        bare = [F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]  # without the array's brackets
        text = bare[0] if single else F.concat(F.lit("["), F.concat_ws(",", *bare), F.lit("]"))
        return edges.select("from", "to", F.lit("common").alias("primitive"), F.array(*[F.lit(n) for n in names]).alias("fields"), text.alias("value"), F.lit(None).cast("double").alias("measure"))

    def _evidence(self, edges: DataFrame, primitive: str, field: str, measure: str) -> DataFrame:
        return edges.select("from", "to", F.lit(primitive).alias("primitive"), F.array(F.lit(field)).alias("fields"), F.lit(None).cast("string").alias("value"), F.col(measure).alias("measure"))

    def similar(self, scope: DataFrame, c: X.Similar) -> DataFrame:
        owners = [(n, t.fields[c.field]) for n, t in self.schema.types.items() if c.field in t.fields and t.fields[c.field].base == "Vector"]
        rows = self._union([self._typed(scope, n).select("id", F.col(c.field).alias("v")) for n, _ in owners]).dropDuplicates(["id"])
        f = owners[0][1]
        return self._evidence(discovery.similar_pairs(rows, c.score, f.metric, f.dim, c.strict), "similar", c.field, "score")

    def near(self, scope: DataFrame, c: X.Close) -> Found:
        owners = [n for n, t in self.schema.types.items() if c.field in t.fields and t.fields[c.field].base == "Point"]
        rows = self._union([self._typed(scope, n).select("id", F.col(f"{c.field}.lat").alias("lat"), F.col(f"{c.field}.lon").alias("lon")) for n in owners]).dropDuplicates(["id"])
        met = discovery.near(rows, c.metres, c.strict)
        return Found(met.nodes, self._evidence(met.pairs(), "near", c.field, "distance"))

"""Syntax trees to DataFrames.

A selection becomes a chain of joins: rows of a type, filtered; one join for
each relationship; semi-joins for walks in filters; windows for limits within
a parent.  The result is either *flat*, one row for each path through the
selection with dotted column names, which scales with its rows; or *nested*,
one row for each root with arrays of structs, as the language shows it.

Every row that a walk reaches is an *instance*: the node, the key of its
parent instance, the hops so far and the edge by which it was reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, vectors
from ..operators import predicates, temporal, walks
from ..operators.paths import routes
from ..sources.graph import Graph
from ..sources.staging import merged
from . import periods
from . import syntax as X
from .errors import QueryError
from .schema import METRES, Edge, Field


@dataclass(frozen=True)
class Context:
    """What holds for a whole statement."""

    source: str = ""
    samples: tuple[int, ...] = ()
    work: walks.Work | None = None
    history: Graph | None = None  # the graph before any dated view


class Lowering:
    def __init__(self, graph: Graph, context: Context | None = None):
        self.graph, self.context = graph, context or Context()
        self.schema = graph.schema
        self._n = 0
        self.trace: list[tuple[DataFrame, list[str]]] | None = None

    def fresh(self, prefix: str) -> str:
        self._n += 1
        return f"_{prefix}{self._n}"

    def field(self, types, name: str) -> Field | None:
        for t in types:
            if name in self.schema.types[t].fields:
                return self.schema.types[t].fields[name]
        return None

    # --- conditions -------------------------------------------------------

    def keep(self, df: DataFrame, types, condition) -> DataFrame:
        """Rows of ``df`` (id and fields) that pass.

        Tests of a top-level && go in turn: plain ones first, as filters that
        reach the scan; walks as semi- or anti-joins, which drop rows before
        the next is made.
        """
        if condition is None:
            return df
        parts = condition.parts if isinstance(condition, X.And) else (condition,)
        plain = [p for p in parts if not self._joins(p)]
        for p in plain:
            df = df.filter(self.attach(df, types, p)[1])
        rest = [p for p in parts if self._joins(p)]
        chains = [p for p in rest if isinstance(p, X.Chain)]
        for group in self._groups(chains):
            ids = self.chain_ids(df, types, group)
            df = df.join(ids, "id", "left_anti" if group[0].negated else "left_semi")
        for p in rest:
            if isinstance(p, X.Chain):
                continue
            columns = df.columns
            df, flag = self.attach(df, types, p)
            df = df.filter(flag).select(*columns)
        return df

    def _joins(self, c) -> bool:
        """Whether a condition reads more than the node itself."""
        if isinstance(c, (X.And, X.Or)):
            return any(self._joins(p) for p in c.parts)
        return isinstance(c, (X.Chain, X.Recorded, X.Moment))

    def attach(self, df: DataFrame, types, c) -> tuple[DataFrame, Column]:
        """``df`` with helper columns, and the condition as a column over it."""
        if isinstance(c, X.And):
            flags, chains = [], [p for p in c.parts if isinstance(p, X.Chain)]
            for p in c.parts:
                if not isinstance(p, X.Chain):
                    df, f = self.attach(df, types, p)
                    flags.append(f)
            for group in self._groups(chains):
                df, f = self._flagged(df, self.chain_ids(df, types, group), group[0].negated)
                flags.append(f)
            out = flags[0]
            for f in flags[1:]:
                out = out & f
            return df, out
        if isinstance(c, X.Or):
            out = F.lit(False)
            for p in c.parts:
                df, f = self.attach(df, types, p)
                out = out | f
            return df, out
        if isinstance(c, X.Chain):
            return self._flagged(df, self.chain_ids(df, types, [c]), c.negated)
        if isinstance(c, X.Recorded):
            return self._flagged(df, self.recorded(df, types, c), False)
        if isinstance(c, X.Moment):
            name = self.fresh("moment")
            df = df.join(self.moments(df, types, c).withColumnRenamed("t", name), "id", "left")
            return df, self._moment_test(types, c, F.col(name))
        if isinstance(c, X.IdCompare):
            own = F.col("id")
            if self.graph.unrolled:
                own = F.call_function("div", own, F.lit(self.graph.unrolled))
            v = F.lit(c.value)
            return df, {"=": own == v, "!=": own != v, "<": own < v, "<=": own <= v, ">": own > v, ">=": own >= v}[c.op]
        field = self.field(types, c.field)
        if isinstance(c, X.Compare):
            return df, predicates.compare(c, field, F.col(c.field))
        return df, predicates.measured(c, field, F.col(c.field))

    def _flagged(self, df, ids, negated: bool):
        flag = self.fresh("has")
        df = df.join(ids.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left")
        found = F.coalesce(F.col(flag), F.lit(False))
        return df, ~found if negated else found

    # --- walks in filters -------------------------------------------------

    def _groups(self, chains):
        """Chains that name each other's nodes belong together; each other chain is alone."""
        groups: list[list[X.Chain]] = []
        for c in chains:
            names = {c.start, c.end} - {None}
            met = [g for g in groups if any(s.rel in names for o in g if not o.negated for s in o.steps)] if names else []
            merged = [x for g in met for x in g] + [c]
            groups = [g for g in groups if g not in met] + [merged]
        return groups

    def chain_ids(self, df: DataFrame, types, group) -> DataFrame:
        """``id`` of the nodes that pass a chain, or a group of chains at once."""
        if len(group) == 1 and group[0].start is None and group[0].end is None:
            return self._backward(df, tuple(types), group[0])
        return self._correlated(df, tuple(types), group)

    def _hop(self, types, rel: str) -> tuple[DataFrame, tuple[str, ...]]:
        """(src, dst) of a relationship from nodes of ``types``, and the types that it reaches."""
        frames, targets = [], {}
        for t in types:
            edge = self.schema.types[t].edges.get(rel)
            if edge is None:
                continue
            adj = self.graph.adjacency(t, rel).select("src", "dst")
            frames.append(self._bounded(adj, t, edge))
            targets |= dict.fromkeys(edge.targets)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out, tuple(targets)

    def _bounded(self, adj: DataFrame, owner: str, edge: Edge) -> DataFrame:
        """Edges whose ends are of the declared types; joins only where the kind has other ends too."""
        if self.graph.dated and (self.schema.lifetimes() or self.graph.unrolled):
            near, far = {owner}, set(edge.targets)
            adj = adj.join(self.graph.nodes_of(tuple(near)).select(F.col("id").alias("src")), "src", "left_semi")
            return adj.join(self.graph.nodes_of(tuple(far)).select(F.col("id").alias("dst")), "dst", "left_semi")
        if not self.schema.ends(edge.kind, edge.out) <= {owner}:
            adj = adj.join(self.graph.node(owner).select(F.col("id").alias("src")), "src", "left_semi")
        if not self.schema.ends(edge.kind, not edge.out) <= set(edge.targets):
            adj = adj.join(self.graph.nodes_of(tuple(edge.targets)).select(F.col("id").alias("dst")), "dst", "left_semi")
        return adj

    def _passing(self, types, condition) -> DataFrame | None:
        """``id`` of the nodes of ``types`` that pass; None if all do."""
        return None if condition is None else self.keep(self.graph.nodes_of(types), types, condition).select("id")

    def _backward(self, df: DataFrame, types, chain: X.Chain) -> DataFrame:
        """From the last step's nodes back to the first: one semi-join a step, a node at most once."""
        hops, now = [], types
        for s in chain.steps:
            adj, targets = self._hop(now, s.rel)
            hops.append((s, adj, targets))
            now = targets
        alive: DataFrame | None = None
        for s, adj, targets in reversed(hops):
            ok = self._passing(targets, s.condition)
            if ok is not None and alive is not None:
                alive = alive.join(ok, "id", "left_semi")
            elif ok is not None:
                alive = ok
            if s.low == s.high == 1:
                if alive is not None:
                    adj = adj.join(alive.select(F.col("id").alias("dst")), "dst", "left_semi")
                alive = adj.select(F.col("src").alias("id")).distinct()
            elif s.low == 1:
                ends = alive if alive is not None else self.graph.nodes_of(targets).select("id")
                alive = walks.within(ends, adj.select("src", "dst"), s.high, self.context.work)
            else:
                starts = adj.select("src").distinct().select(F.col("src").alias("start"), F.col("src").alias("node"))
                found = walks.reach(starts, adj.withColumn("rel_id", F.lit(0).cast("long")), s.low, s.high, work=self.context.work)
                if alive is not None:
                    found = found.join(alive.select(F.col("id").alias("node")), "node", "left_semi")
                alive = found.select(F.col("start").alias("id")).distinct()
        return alive

    def _correlated(self, df: DataFrame, types, group) -> DataFrame:
        """Chains that share nodes: bindings of the shared nodes travel as columns."""
        wanted = {n for c in group for n in (c.start, c.end) if n}
        rows = df.select("id")
        reached: dict[str, tuple[str, ...]] = {}
        for c in group:
            now = types
            cur = F.col("id")
            if c.start is not None:
                now, cur = reached[c.start], F.col(f"@{c.start}")
            rows = rows.withColumn("_cur", cur)
            steps = list(c.steps)
            if c.start is not None:
                first = steps.pop(0)
                ok = self._passing(now, first.condition)
                if ok is not None:
                    rows = rows.join(ok.withColumnRenamed("id", "_cur"), "_cur", "left_semi")
            for s in steps:
                rows, now = self._advance(rows, now, s)
                if s.rel in wanted and s.rel not in reached:
                    rows = rows.withColumn(f"@{s.rel}", F.col("_cur"))
                    reached[s.rel] = now
            if c.end is not None:
                rows, _ = self._advance(rows, now, X.Step(c.end, 1, 1))
                rows = rows.filter(F.col("_cur") == F.col(f"@{c.end}"))
            rows = rows.drop("_cur").distinct()
        return rows.select("id").distinct()

    def _advance(self, rows: DataFrame, types, s: X.Step):
        adj, targets = self._hop(types, s.rel)
        if not s.low == s.high == 1:
            starts = rows.select("_cur").distinct().select(F.col("_cur").alias("start"), F.col("_cur").alias("node"))
            adj = walks.reach(starts, adj.withColumn("rel_id", F.lit(0).cast("long")), s.low, s.high, work=self.context.work).select(F.col("start").alias("src"), F.col("node").alias("dst"))
        ok = self._passing(targets, s.condition)
        if ok is not None:
            adj = adj.join(ok.select(F.col("id").alias("dst")), "dst", "left_semi")
        adj = adj.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        rows = rows.join(adj, rows["_cur"] == adj["_src"]).drop("_cur", "_src").withColumnRenamed("_dst", "_cur")
        return rows.distinct(), targets

    # --- tests over recorded states ---------------------------------------

    def _touches(self, c, types) -> tuple[set[str], set[str], set[str], bool]:
        """(fields, types, kinds) that a condition reads, and whether it walks."""
        if c is None:
            return set(), set(types), set(), False
        if isinstance(c, (X.And, X.Or)):
            got = [self._touches(p, types) for p in c.parts]
            return set().union(*(g[0] for g in got)), set().union(*(g[1] for g in got)), set().union(*(g[2] for g in got)), any(g[3] for g in got)
        if isinstance(c, X.Chain):
            seen, kinds = set(types), set()
            for t in self.schema.types.values():  # whatever the chain may pass
                for s in c.steps:
                    if s.rel in t.edges:
                        kinds.add(t.edges[s.rel].kind)
                        seen |= {t.name, *t.edges[s.rel].targets}
                if c.end and c.end in t.edges:
                    kinds.add(t.edges[c.end].kind)
                    seen |= {t.name, *t.edges[c.end].targets}
            return set(), seen, kinds, True
        if isinstance(c, (X.Recorded, X.Moment)):
            f, t, k, _ = self._touches(c.condition, types)
            return f, t, k, True
        return ({c.field} if hasattr(c, "field") else set()), set(types), set(), False

    def _states(self, df: DataFrame, types, condition, window=None) -> DataFrame:
        """``id, t, ok``: a condition at each recorded state (or boundary of a window) of the nodes of ``df``."""
        past = self.context.history or self.graph
        fields, seen, kinds, walking = self._touches(condition, types)
        ids = df.select("id").distinct()
        start = stop = None
        if window:
            start = dates.instant(periods.instant(past, types, window[0], False, self.context.source))
            stop = dates.instant(periods.instant(past, types, window[1], True, self.context.source))
        if not walking:
            found = []
            for t in types:
                mine = past.node(t).select("id").join(ids, "id", "left_semi")
                points = temporal.own_boundaries(past, t, fields).join(ids, "id", "left_semi")
                if window:
                    points = temporal.window_points(points, mine, start, stop)
                rows = temporal.states(past, t, points, fields)
                now = past.visible(t, rows, F.col("t")) if window else rows
                flagged = now.select("id", "t", Lowering(past, self.context).attach(now, (t,), condition)[1].alias("ok"))
                if window:
                    flagged = points.join(flagged, ["id", "t"], "left").select("id", "t", F.coalesce("ok", F.lit(False)).alias("ok"))
                found.append(flagged)
            out = found[0]
            for f in found[1:]:
                out = out.unionAll(f)
            return out
        instants = temporal.all_boundaries(past, seen, kinds)
        if window:
            instants = instants.filter((F.col("t") > start) & (F.col("t") < stop)).unionAll(past.spark.range(1).select(F.explode(F.array(start, stop)).alias("t"))).distinct()
        k, most = self._numbered(instants)
        wide = past.at_each(k, most)
        low = Lowering(wide, self.context)
        frame = wide.nodes_of(tuple(types))
        frame, ok = low.attach(frame, tuple(types), condition)
        flagged = frame.select(F.col("id").alias("code"), ok.alias("ok"))
        everyone = ids.crossJoin(F.broadcast(k)).select("id", "t", (F.col("id") * most + F.col("k")).alias("code"))
        met = everyone.join(flagged, "code", "left" if window else "inner")
        return met.select("id", "t", F.coalesce("ok", F.lit(False)).alias("ok"))

    def _numbered(self, instants: DataFrame) -> tuple[DataFrame, int]:
        """(k, t) numbered in order, and a number above all k.  Instants are few: they are what a test can see."""
        from ..sources.staging import staged

        k = staged(instants.select("t", (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("k")), "instants")
        n = k.count()
        return k, 1 << max(1, int(n).bit_length())

    def recorded(self, df: DataFrame, types, c: X.Recorded) -> DataFrame:
        """``id`` of nodes for which a test ever (always) holds; never without a recorded state."""
        s = self._states(df, types, c.condition, c.window).groupBy("id")
        return s.agg((F.bool_and if c.always else F.bool_or)("ok").alias("ok")).filter("ok").select("id")

    def moments(self, df: DataFrame, types, c: X.Moment) -> DataFrame:
        """``id, t``: the first (last) recorded instant at which a test holds."""
        held = self._states(df, types, c.condition).filter("ok").groupBy("id")
        return held.agg((F.max if c.last else F.min)("t").alias("t"))

    def _moment_test(self, types, c: X.Moment, t: Column) -> Column:
        if c.date.year is not None or (c.date.word is not None and c.date.edge is None):
            last = c.op in (">", "<=")
        else:
            last = False
        v = dates.instant(periods.instant(self.context.history or self.graph, types, c.date, last, self.context.source))
        if c.op == "!=":
            return ~t.eqNullSafe(v)
        return F.coalesce({"=": t == v, "<": t < v, "<=": t <= v, ">": t > v, ">=": t >= v}[c.op], F.lit(False))

    # --- order and limit --------------------------------------------------

    def score(self, types, near: X.Near) -> Column:
        f = self.field(types, near.field)
        return vectors.score(F.col(near.field), vectors.literal(near.vector.items), f.metric)

    def ordered(self, df: DataFrame, s: X.Selection, parent: list[str]) -> tuple[DataFrame, list[Column]]:
        """Rows after near, order and limit, and the keys of their order."""
        keys: list[Column] = []
        if s.near:
            df = df.withColumn("_score", self.score(s.types, s.near)).filter(F.col("_score").isNotNull())
            df = self._first(df, parent, [F.desc("_score"), F.asc("id")], s.near.k)
            keys = [F.desc("_score")]
        own: list[Column] = []
        for i, k in enumerate(s.order):
            if isinstance(k.by, X.Distance):
                name = f"_order{i}"
                df = df.withColumn(name, geo.distance(F.col(k.by.field), k.by.point.lat, k.by.point.lon)).filter(F.col(name).isNotNull())
            else:
                name = k.by
            own.append(F.desc_nulls_last(name) if k.descending else F.asc_nulls_last(name))
        keys = own or keys
        if s.limit is not None:
            df = self._first(df, parent, [*keys, F.asc("id")], s.limit)
        return df, keys

    def _first(self, df: DataFrame, parent: list[str], keys, n: int) -> DataFrame:
        if parent or self.graph.unrolled:
            groups = [F.col(p) for p in parent] or [F.col("id") % self.graph.unrolled]
            w = Window.partitionBy(*groups).orderBy(*keys)
            return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
        return df.orderBy(*keys).limit(n)

    # --- selections -------------------------------------------------------

    def roots(self, s: X.Selection) -> tuple[DataFrame, list[Column]]:
        """Instances of a root selection: id, fields, ``_key``, ``_hops``."""
        df = self.keep(self.graph.nodes_of(s.types), s.types, s.condition)
        df, keys = self.ordered(df, s, [])
        return df.withColumn("_key", F.col("id").cast("string")).withColumn("_hops", F.lit(0)), keys

    def children(self, parents: DataFrame, types, w: X.Walk) -> tuple[DataFrame, list[Column]]:
        """Instances that a walk reaches from parent instances (id, _key, _hops).

        Columns: the target's id and fields, ``_parent``, ``_key``, ``_hops``,
        ``_rel`` and the properties of the arriving edge as ``&name``.
        """
        s = w.target
        frames = []
        for t in types:
            edge = self.schema.types[t].edges.get(w.field)
            if edge is None:
                continue
            adj = self.graph.adjacency(t, w.field)
            mine = parents
            if len(types) > 1:
                mine = parents.filter(F.col("_type") == t)
            elif not self.schema.ends(edge.kind, edge.out) <= {t}:
                mine = parents  # parents are of the type already
            frames.append((mine.select(F.col("id").alias("_from"), F.col("_key").alias("_parent"), F.col("_hops").alias("_before")), adj, edge))
        found = []
        for mine, adj, edge in frames:
            if w.ranged:
                needs = any(isinstance(i, X.EdgeProp) for i in s.items)
                keyed = mine.select("_from").distinct().select(F.col("_from").alias("start"), F.col("_from").alias("node"))
                bounded = self._bounded(adj, types[0], edge)
                r = walks.reach(keyed, bounded, w.low, w.high, needs, self.context.work)
                hop = r.select(F.col("start").alias("_from"), F.col("node").alias("_to"), F.col("depth").alias("_depth"), (F.col("rel_id") if needs else F.lit(None).cast("long")).alias("_rel"))
                if needs:
                    props = adj.select(F.col("rel_id").alias("_rel"), *[c for c in adj.columns if c.startswith("&")]).dropDuplicates(["_rel"])
                    hop = hop.join(props, "_rel", "left")
            else:
                hop = adj.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.lit(1).alias("_depth"), F.col("rel_id").alias("_rel"), *[c for c in adj.columns if c.startswith("&")])
                if not edge.many:
                    hop = self._single(hop, w)
            found.append(mine.join(hop, "_from").drop("_from"))
        met = found[0]
        for f in found[1:]:
            met = met.unionByName(f, allowMissingColumns=True)
        target = self.keep(self.graph.nodes_of(s.types), s.types, s.condition)
        df = met.join(target, met["_to"] == target["id"]).drop("_to")
        # one instance for each arrival: parallel edges give a node once each
        df = df.withColumn("_key", F.concat_ws("/", "_parent", F.col("id").cast("string"), F.coalesce(F.col("_rel"), F.lit(0)).cast("string")))
        df = df.withColumn("_hops", F.col("_before") + F.col("_depth")).drop("_before")
        df, keys = self.ordered(df, s, ["_parent"])
        if not keys and w.ranged:
            keys = [F.asc("_depth")]
        return df, keys

    def _single(self, hop: DataFrame, w: X.Walk) -> DataFrame:
        """To-one relationships: a second one is an error where it is read."""
        n = F.count(F.lit(1)).over(Window.partitionBy("_from"))
        message = F.concat(F.lit(f"{w.field} leads to more than one node from "), F.col("_from").cast("string"))
        return hop.withColumn("_n", n).withColumn("_to", F.when(F.col("_n") > 1, F.raise_error(message).cast("long")).otherwise(F.col("_to"))).drop("_n")

    def value(self, df: DataFrame, types, i) -> tuple[DataFrame, Column]:
        """One selected value of an instance."""
        if isinstance(i, X.Prop):
            f = self.field(types, i.name)
            c = F.col(i.name)
            return df, dates.dated_text(c) if f.base == "Date" and not f.many else c
        if isinstance(i, X.EdgeProp):
            return df, F.col(f"&{i.name}")
        if i.what == "id":
            return df, F.call_function("div", F.col("id"), F.lit(self.graph.unrolled)) if self.graph.unrolled else F.col("id")
        if i.what == "hops":
            return df, F.col("_hops").cast("long")
        if i.what == "score":
            return df, F.col("_score")
        if i.what == "distance":
            return df, geo.distance(F.col(i.arg.field), i.arg.point.lat, i.arg.point.lon)
        if i.what == "similarity":
            return df, vectors.score(F.col(i.arg.field), vectors.literal(i.arg.vector.items), self.field(types, i.arg.field).metric)
        name = self.fresh(i.what)
        if i.what == "moment":
            found = self.moments(df, types, i.arg).select("id", dates.dated_text(F.col("t")).alias(name))
            return df.join(found, "id", "left"), F.col(name)
        past = self.context.history or self.graph
        frames = [temporal.series(past, t, i.arg, df, list(self.context.samples)) for t in types if i.arg in self.schema.types[t].fields]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionAll(f)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: F.struct(dates.dated_text(x.t).alias("time"), x.value.alias("value")))
        return df.join(rows.groupBy("id").agg(listed.alias(name)), "id", "left"), F.col(name)

    def note(self, df: DataFrame, columns) -> None:
        if self.trace is not None:
            self.trace.append((df, columns))

    # --- nested results ---------------------------------------------------

    def nested(self, df: DataFrame, s: X.Selection, types=None) -> DataFrame:
        """``_key`` with ``out``, a struct of the selected items with its names in order.

        Array items carry their place only while they are collected.
        """
        types = types or s.types
        columns: dict[str, Column] = {}
        joins: list[DataFrame] = []
        self.note(df, ["id"])
        for i in s.items:
            if not isinstance(i, X.Walk):
                df, c = self.value(df, types, i)
                columns[i.alias] = c
                continue
            made, many = self.walked(df, types, i)
            name = self.fresh("walk")
            joins.append((made.withColumnRenamed("_parent", "_key").withColumnRenamed("out", name), name))
            empty = F.array().cast(made.schema["out"].dataType)
            columns[i.alias] = F.coalesce(F.col(name), empty) if many else F.col(name)
        for j, _ in joins:
            df = df.join(j, "_key", "left")
        out = F.struct(*[columns[n].alias(n) for n in sorted(columns)]) if columns else F.struct(F.lit(None).cast("string").alias("_"))
        return df.withColumn("out", out)

    def walked(self, df: DataFrame, types, w: X.Walk) -> tuple[DataFrame, bool]:
        """(_parent, out) of one walk for each parent instance, and whether it is a list."""
        edges = [self.schema.types[t].edges[w.field] for t in types if w.field in self.schema.types[t].edges]
        if w.path:
            return self.path(df, types, w, edges[0]), False
        if w.target.window:
            return self.windowed_walk(df, types, w)
        kids, keys = self.children(df, types, w)
        if self.trace is not None:
            self.note(kids, ["id", "_rel"])
        rows = self.nested(kids, w.target)
        many = any(e.many for e in edges) or w.ranged or len(w.target.types) > 1 or bool(w.target.near or w.target.order) or w.target.limit is not None
        if many:
            if keys:
                w = Window.partitionBy("_parent").orderBy(*keys, F.asc("id"), F.asc_nulls_first("_rel"))
                rows = rows.withColumn("_o1", F.row_number().over(w)).withColumn("_o2", F.lit(0))
            else:
                rows = rows.withColumn("_o1", F.col("id")).withColumn("_o2", F.coalesce("_rel", F.lit(0)))
            listed = F.transform(F.array_sort(F.collect_list(F.struct("_o1", "_o2", "out"))), lambda x: x.out)
            return rows.groupBy("_parent").agg(listed.alias("out")), True
        return rows.groupBy("_parent").agg(F.first("out").alias("out")), False

    # --- flat results -----------------------------------------------------

    def flat(self, df: DataFrame, s: X.Selection, types=None, prefix: str = "") -> tuple[DataFrame, list[str]]:
        """One row for each path through nested walks, outer where a walk finds nothing; dotted names.

        Columns are the names after a `=`, so that no field is taken for the id of its node.
        """
        types = types or s.types
        out: dict[str, Column] = {}
        walk = [i for i in s.items if isinstance(i, X.Walk)]
        for i in s.items:
            if not isinstance(i, X.Walk):
                df, c = self.value(df, types, i)
                out[f"{prefix}{i.alias}"] = c
        mine = df.select("id", "_key", *(["_hops"] if "_hops" in df.columns else []), *(["_type"] if "_type" in df.columns else []), *(["_parent"] if "_parent" in df.columns else []), *[c.alias(f"={n}") for n, c in out.items()])
        names = list(out)
        for w in walk:
            kids, _ = self.children(mine, types, w)
            below, more = self.flat(kids, w.target, prefix=f"{prefix}{w.alias}.")
            below = below.select(F.col("_parent").alias("_key"), *[F.col(f"`={n}`") for n in more])
            mine = mine.join(below, "_key", "left")
            names += more
        return mine, names

    # --- paths ------------------------------------------------------------

    def path(self, df: DataFrame, types, w: X.Walk, edge: Edge) -> DataFrame:
        """(_parent, out) of the best route for each instance: cost, hops, nodes, edges."""
        p, s = w.path, w.target
        adj = self._bounded(self.graph.adjacency(types[0], w.field), types[0], edge)
        for t in s.types:
            if t not in types:
                adj = adj.unionByName(self._bounded(self.graph.adjacency(t, w.field), t, self.schema.types[t].edges[w.field]))
        adj = adj.join(merged(self.graph.nodes_of(s.types).select(F.col("id").alias("dst"))), "dst", "left_semi")
        goals = self.keep(self.graph.nodes_of(s.types), s.types, s.condition).select("id")
        points, unit = None, None
        weight_field = edge.props.get(p.weight) if p.weight else None
        if p.toward:
            everyone = tuple(dict.fromkeys((*types, *s.types)))
            points = self.graph.nodes_of(everyone).select("id", F.col(f"{p.toward}.lat").alias("lat"), F.col(f"{p.toward}.lon").alias("lon"))
            unit = METRES[weight_field.unit]
        bound = (p.bound[1], float(p.bound[2])) if p.bound else None
        found = routes(df.select("id").distinct(), adj, goals, p.weight, edge.kind, bound, points, unit, self.context.work)
        cost = F.col("cost").cast("long") if weight_field is None or weight_field.base == "Int" else F.col("cost")
        # the nodes of a route, each with the edge that arrives there
        at = F.posexplode(F.arrays_zip(F.col("nodes").alias("node"), F.concat(F.array(F.lit(None).cast("bigint")), "rels").alias("rel")))
        steps = found.select("start", at.alias("pos", "x")).select("start", "pos", F.col("x.node").alias("id"), F.col("x.rel").alias("_rel"))
        props = adj.select(F.col("rel_id").alias("_rel"), "src", "dst", *[c for c in adj.columns if c.startswith("&")]).dropDuplicates(["_rel"])
        everyone = self.graph.nodes_of(tuple(dict.fromkeys((*types, *s.types))))
        rows = steps.join(merged(everyone), "id").join(merged(props), "_rel", "left")
        rows = rows.withColumn("_key", F.concat_ws("/", "start", "pos")).withColumn("_hops", F.col("pos"))
        if self.trace is not None:
            self.note(rows, ["id", "_rel"])
        shown = self.nested(rows, X.Selection(s.types, items=s.items), tuple(dict.fromkeys((*types, *s.types))))
        a, b = (F.col("src"), F.col("dst")) if edge.out else (F.col("dst"), F.col("src"))
        names = sorted(edge.props)
        held = F.struct(*[F.col(f"&{n}").alias(n) for n in names]) if names else F.struct(F.lit(None).cast("string").alias("_"))
        one = F.struct(F.col("_rel").alias("id"), F.lit(edge.kind).alias("type"), a.alias("from"), b.alias("to"), held.alias("props"))
        listed = shown.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("out").alias("node"), F.when(F.col("pos") > 0, one).alias("edge")))).alias("x"))
        out = F.struct(cost.alias("cost"), F.transform(F.filter("x", lambda x: x.pos > 0), lambda x: x.edge).alias("edges"), F.col("hops"), F.transform("x", lambda x: x.node).alias("nodes"))
        met = found.join(merged(listed), "start").select("start", out.alias("out"))
        return df.select(F.col("_key").alias("_parent"), F.col("id").alias("start")).join(merged(met), "start").select("_parent", "out")

    # --- windows ----------------------------------------------------------

    def _window_graph(self, types, kinds, window: X.Window, owner) -> tuple[Graph, DataFrame, int]:
        past = self.context.history or self.graph
        a = periods.instant(past, owner, window.start, False, self.context.source)
        b = periods.instant(past, owner, window.stop, True, self.context.source)
        start, stop = dates.instant(a), dates.instant(b)
        ends = past.spark.range(1).select(F.explode(F.array(start, stop)).alias("t"))
        inside = temporal.all_boundaries(past, types, kinds).filter((F.col("t") > start) & (F.col("t") < stop))
        instants = ends if window.changes else inside.unionAll(ends)
        k, most = self._numbered(instants.distinct())
        return past.at_each(k, most), k, most

    def _reads(self, s: X.Selection, types) -> tuple[set[str], set[str]]:
        """Types and kinds that a selection can see."""
        _, seen, kinds, _ = self._touches(s.condition, types)
        seen |= set(s.types)
        for i in s.items:
            if isinstance(i, X.Walk):
                for t in s.types:
                    e = self.schema.types[t].edges.get(i.field)
                    if e:
                        kinds.add(e.kind)
                        seen |= set(e.targets)
                a, b = self._reads(i.target, i.target.types)
                seen |= a
                kinds |= b
        return seen, kinds

    def windowed(self, s: X.Selection, window: X.Window) -> DataFrame:
        """A root selection over a window: ``id, out`` by first match, or joined, left and changed."""
        bare = X.Selection(s.types, s.condition, s.items, s.near, s.order, s.limit, None, at=s.at)
        if not (window.changes or s.near or s.order or s.limit is not None or self._joins(s.condition) or any(isinstance(i, X.Walk) for i in s.items)):
            return self._own_window(bare, window)
        seen, kinds = self._reads(bare, s.types)
        wide, k, most = self._window_graph(seen, kinds, window, s.types)
        low = Lowering(wide, self.context)
        rows, _ = low.roots(bare)
        rows = low.nested(rows, bare).select((F.col("id") % most).alias("k"), F.call_function("div", F.col("id"), F.lit(most)).alias("id"), "out")
        if not window.changes:
            return rows.groupBy("id").agg(F.min_by("out", "k").alias("out"))
        return self.changed(rows, ["id"], k.count() - 1)

    def _own_window(self, s: X.Selection, window: X.Window) -> DataFrame:
        """A window over nodes alone: what they show changes only at their own boundaries, so each is tried at those."""
        past = self.context.history or self.graph
        start = dates.instant(periods.instant(past, s.types, window.start, False, self.context.source))
        stop = dates.instant(periods.instant(past, s.types, window.stop, True, self.context.source))
        fields = self._touches(s.condition, s.types)[0] | {i.name for i in s.items if isinstance(i, X.Prop)} | {i.arg.field for i in s.items if isinstance(i, X.Builtin) and hasattr(i.arg, "field")}
        found = None
        for t in s.types:
            points = temporal.window_points(temporal.own_boundaries(past, t, fields), past.node(t).select("id"), start, stop)
            rows = past.visible(t, temporal.states(past, t, points, fields), F.col("t"))
            low = Lowering(past, self.context)
            rows = low.keep(rows, (t,), s.condition).withColumn("_key", F.col("id").cast("string")).withColumn("_hops", F.lit(0))
            rows = low.nested(rows, s, (t,)).groupBy("id").agg(F.min_by("out", "t").alias("out"))
            found = rows if found is None else found.unionByName(rows)
        return found

    def changed(self, rows: DataFrame, key: list[str], last: int) -> DataFrame:
        """Key, what (joined, left, changed), before, after: the two end states compared."""
        a = rows.filter("k = 0").select(*key, F.col("out").alias("before"))
        b = rows.filter(F.col("k") == last).select(*key, F.col("out").alias("after"))
        both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
        what = F.when(F.col("_a").isNull(), "joined").when(F.col("_b").isNull(), "left").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        return both.withColumn("what", what).filter("what is not null").select(*key, "what", "before", "after")

    def windowed_walk(self, df: DataFrame, types, w: X.Walk) -> tuple[DataFrame, bool]:
        """A walk with a window, for each parent instance."""
        s = w.target
        bare = X.Selection(s.types, s.condition, s.items, s.near, s.order, s.limit, None, at=s.at)
        seen, kinds = self._reads(X.Selection(tuple(types), None, (X.Walk(w.field, w.out, bare, w.alias),)), types)
        wide, k, most = self._window_graph(seen, kinds, s.window, s.types)
        low = Lowering(wide, self.context)
        starts = df.select("id", "_key", "_hops", *(["_type"] if "_type" in df.columns else [])).crossJoin(F.broadcast(k.select("k")))
        starts = starts.withColumn("_key", F.concat_ws("@", "_key", "k")).withColumn("id", F.col("id") * most + F.col("k")).drop("k")
        alive = wide.nodes_of(tuple(types)).select("id")
        kids, _ = low.children(starts.join(alive, "id", "left_semi"), types, X.Walk(w.field, w.out, bare, w.alias, w.low, w.high, w.ranged))
        rows = low.nested(kids, bare)
        rows = rows.select(F.substring_index("_parent", "@", 1).alias("_parent"), (F.col("id") % most).alias("k"), F.call_function("div", F.col("id"), F.lit(most)).alias("id"), "out")
        if not s.window.changes:
            one = rows.groupBy("_parent", "id").agg(F.min_by("out", "k").alias("out"))
            listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "out"))), lambda x: x.out)
            return one.groupBy("_parent").agg(listed.alias("out")), True
        once = rows.groupBy("_parent", "id", "k").agg(F.first("out").alias("out"))
        return changes_struct(self.changed(once, ["_parent", "id"], k.count() - 1), ["_parent"]), False


def changes_struct(rows: DataFrame, key: list[str]) -> DataFrame:
    """``out`` {changed, joined, left} for each key from the rows of ``changed``."""

    def listed(what, column):
        xs = F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("id", column.alias("row")))))
        return F.transform(xs, lambda x: x.row)

    changed = F.struct(F.col("before").alias("from"), F.col("id").alias("id"), F.col("after").alias("to"))
    grouped = rows.groupBy(*key) if key else rows.groupBy()
    out = F.struct(listed("changed", changed).alias("changed"), listed("joined", F.col("after")).alias("joined"), listed("left", F.col("before")).alias("left"))
    return grouped.agg(out.alias("out"))


def root_error(s: X.Selection) -> QueryError:
    return QueryError(f"{s.types[0]} matched more than one row", hint="name one node, or ask for a list with a comparison or a limit")

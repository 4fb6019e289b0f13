"""What a new schema would do to the data: changes with counts and severity.

``affected`` is counted from the data; a change Blocks, Warns or is Safe.
The counts of one type are one aggregation over its frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values
from ..plans.schema import Edge, Field, NodeType, Schema
from ..sources.graph import Graph


@dataclass(frozen=True)
class SchemaChange:
    change: str
    subject: str
    affected: int
    severity: str

    @property
    def text(self) -> str:
        return f"{self.change} {self.subject} ({self.affected} affected)"


@dataclass(frozen=True)
class Report:
    changes: tuple[SchemaChange, ...]

    @property
    def ok(self) -> bool:
        return all(c.severity != "Blocks" for c in self.changes)


def _level(affected: int, above: str, none: str) -> str:
    return above if affected else none


def converts(c: Column, old: Field, new: Field) -> Column:
    """Whether a non-null value of the old type is one of the new type."""
    if old.many or new.many:
        return F.lit(old.same_kind(new))
    if old.base == new.base:
        return F.lit(old.base != "Vector" or old.dim == new.dim)
    if new.base == "String" and old.base in ("Int", "Float", "Bool", "Reference", "Date"):
        return F.lit(True)
    if old.base == "String":
        t = values.trimmed(c)
        if new.base == "Int":
            return t.try_cast("bigint").isNotNull()
        if new.base == "Float":
            return t.try_cast("double").isNotNull()
        if new.base == "Bool":
            return F.lower(t).isin("true", "false")
        return F.lit(new.base == "Reference")
    return F.lit({old.base, new.base} == {"Int", "Float"})


class _Diff:
    def __init__(self, graph: Graph, new: Schema):
        self.graph, self.old, self.new = graph, graph.schema, new
        self.out: list[SchemaChange] = []

    def add(self, change: str, subject: str, affected: int, severity: str) -> None:
        self.out.append(SchemaChange(change, subject, int(affected), severity))

    def run(self) -> Report:
        old, new = self.old.types, self.new.types
        gone, fresh = [n for n in old if n not in new], [n for n in new if n not in old]
        renamed = {}
        if len(gone) == len(fresh) == 1 and self._signature(old[gone[0]]) == self._signature(new[fresh[0]]):
            renamed = {gone[0]: fresh[0]}
            n = self.graph.node(gone[0]).count()
            history = any(t == gone[0] for t, _ in self.graph.history)
            self.add("type renamed", f"{gone[0]} to {fresh[0]}", n, "Blocks" if history else "Warn")
        for n in gone:
            if n not in renamed:
                affected = self.graph.node(n).count()
                self.add("type removed", n, affected, _level(affected, "Blocks", "Warn"))
        for n in fresh:
            if n not in renamed.values():
                self.add("type added", n, self.graph.nodes[n].count() if n in self.graph.nodes else 0, "Safe")
        for n in old:
            if n in new:
                self.fields(old[n], new[n])
                self.edges(old[n], new[n])
                self.clauses(old[n], new[n])
        return Report(tuple(self.out))

    @staticmethod
    def _signature(t: NodeType):
        return ({(f.name, f.base, f.many, f.optional, f.dim) for f in t.fields.values()}, {(e.name, e.kind, e.out, e.many) for e in t.edges.values()})

    # --- fields -----------------------------------------------------------

    def fields(self, a: NodeType, b: NodeType) -> None:
        gone = [f for f in a.fields if f not in b.fields]
        fresh = [f for f in b.fields if f not in a.fields]
        both = [f for f in a.fields if f in b.fields]
        have = {f: F.sum(F.col(f).isNotNull().cast("long")) for f in gone}
        lack = {f: F.sum(F.col(f).isNull().cast("long")) for f in both if a.fields[f].optional and not b.fields[f].optional}
        odd = {f: F.sum((F.col(f).isNotNull() & ~F.coalesce(converts(F.col(f), a.fields[f], b.fields[f]), F.lit(False))).cast("long")) for f in both if not a.fields[f].same_kind(b.fields[f])}
        counts = [F.count(F.lit(1)).alias("n")] + [c.alias(f"{k}:{f}") for k, d in (("have", have), ("lack", lack), ("odd", odd)) for f, c in d.items()]
        got = self.graph.node(a.name).agg(*counts).first().asDict()
        number = lambda k, f: got[f"{k}:{f}"] or 0
        renamed = None
        if len(gone) == len(fresh) == 1:
            x, y = a.fields[gone[0]], b.fields[fresh[0]]
            if x.base == y.base and x.optional == y.optional:
                renamed = (gone[0], fresh[0])
                history = (a.name, gone[0]) in self.graph.history
                self.add("field renamed", f"{a.name}.{gone[0]} to {fresh[0]}", number("have", gone[0]), "Blocks" if history else "Warn")
        for f in both:
            x, y = a.fields[f], b.fields[f]
            subject = f"{a.name}.{f}"
            if not x.same_kind(y):
                self.add("field type changed", subject, number("odd", f), _level(number("odd", f), "Blocks", "Warn"))
            if x.temporal != y.temporal:
                kept = self.graph.changes(a.name, f).select("id").distinct().count() if x.temporal else 0
                self.add("history typing changed", subject, kept, _level(kept, "Blocks", "Safe"))
            if x.optional and not y.optional:
                self.add("optional to required", subject, number("lack", f), _level(number("lack", f), "Blocks", "Warn"))
            if not x.optional and y.optional:
                self.add("required to optional", subject, 0, "Safe")
        if renamed:
            return
        for f in fresh:
            y = b.fields[f]
            self.add("field added", f"{a.name}.{f}", got["n"], "Safe" if y.optional else _level(got["n"], "Blocks", "Warn"))
        for f in gone:
            self.add("field removed", f"{a.name}.{f}", number("have", f), _level(number("have", f), "Blocks", "Warn"))

    # --- relationships ----------------------------------------------------

    def edges(self, a: NodeType, b: NodeType) -> None:
        for n, e in a.edges.items():
            subject = f"{a.name}.{n}"
            if n not in b.edges:
                live = self.graph.rel(e.kind).select("rel_id")
                if e.kind in self.graph.intervals:
                    live = live.unionAll(self.graph.interval(e.kind).select("rel_id")).distinct()
                affected = live.count()
                self.add("relationship removed", subject, affected, _level(affected, "Blocks", "Warn"))
                continue
            f = b.edges[n]
            if (e.kind, e.out, set(e.targets), e.many) != (f.kind, f.out, set(f.targets), f.many):
                affected = self._violating(a.name, e, f)
                self.add("relationship changed", subject, affected, _level(affected, "Blocks", "Warn"))
            if e.temporal != f.temporal:
                kept = self.graph.interval(e.kind).count() if e.temporal else 0
                self.add("history typing changed", subject, kept, _level(kept, "Blocks", "Safe"))
            self.properties(subject, e, f)
        for n in b.edges:
            if n not in a.edges:
                self.add("relationship added", f"{a.name}.{n}", 0, "Safe")

    def _violating(self, owner: str, old: Edge, new: Edge) -> int:
        """Edges of the old kind that the new declaration would not allow."""
        rel = self.graph.rel(old.kind)
        if old.kind != new.kind or old.out != new.out:
            return rel.count()
        far, near = ("dst", "src") if new.out else ("src", "dst")
        known = [t for t in new.targets if t in self.old.types]
        bad = rel
        if known:
            bad = rel.join(self.graph.nodes_of(tuple(known)).select(F.col("id").alias(far)), far, "left_anti")
        total = bad.count()
        if not new.many and old.many:
            mine = rel.join(self.graph.node(owner).select(F.col("id").alias(near)), near, "left_semi")
            extra = mine.groupBy(near).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n")).first()[0]
            total += extra or 0
        return total

    def properties(self, subject: str, e: Edge, f: Edge) -> None:
        names = [*e.props, *(p for p in f.props if p not in e.props)]
        if not names:
            return
        rel = self.graph.rel(e.kind)
        sums = [F.count(F.lit(1)).alias("n")]
        for p in e.props:
            sums.append(F.sum(F.col(p).isNotNull().cast("long")).alias(f"have:{p}"))
            if p in f.props and not e.props[p].same_kind(f.props[p]):
                ok = F.coalesce(converts(F.col(p), e.props[p], f.props[p]), F.lit(False))
                sums.append(F.sum((F.col(p).isNotNull() & ~ok).cast("long")).alias(f"odd:{p}"))
        got = rel.agg(*sums).first().asDict()
        n = got["n"]
        for p in names:
            s = f"{subject}&{p}"
            if p not in f.props:
                have = got[f"have:{p}"] or 0
                self.add("property removed", s, have, _level(have, "Blocks", "Warn"))
            elif p not in e.props:
                self.add("property added", s, n, "Safe" if f.props[p].optional else _level(n, "Blocks", "Safe"))
            else:
                x, y = e.props[p], f.props[p]
                if not x.same_kind(y):
                    odd = got[f"odd:{p}"] or 0
                    self.add("property type changed", s, odd, _level(odd, "Blocks", "Warn"))
                if x.optional and not y.optional:
                    lack = n - (got[f"have:{p}"] or 0)
                    self.add("optional to required", s, lack, _level(lack, "Blocks", "Warn"))
                if not x.optional and y.optional:
                    self.add("required to optional", s, 0, "Safe")

    def clauses(self, a: NodeType, b: NodeType) -> None:
        for what, x, y in (("period", a.period, b.period), ("calendar", a.calendars, b.calendars), ("lifetime", (a.appears, a.ends), (b.appears, b.ends))):
            if x != y:
                first = not x or x == (None, None)
                self.add(f"{what} changed", a.name, 0, "Safe" if first else "Warn")


def schema_diff(graph: Graph, new: Schema) -> Report:
    """Every difference between the graph's schema and ``new``, judged on the data."""
    return _Diff(graph, new).run()

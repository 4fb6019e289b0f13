"""Schemas: node types with typed fields, and relationships between them.

A schema is a closed world: what it does not name does not exist.  Units and
vector metrics travel with the field, not with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import QueryError, nearest

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
SCALARS = {"String": T.StringType(), "Int": T.LongType(), "Float": T.DoubleType(), "Bool": T.BooleanType(), "Date": T.TimestampType(), "Point": POINT, "Reference": T.StringType()}
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.344}
STRING_KINDS = ("url", "iso2", "blake3", "file")
METRICS = ("cosine", "dot", "l2")
VECTOR_MOST = 4096


@dataclass(frozen=True)
class Field:
    """``base`` with what qualifies it; ``columns`` are the source columns it is read from."""

    name: str
    base: str
    optional: bool = False
    many: bool = False
    temporal: bool = False
    unit: str | None = None
    dim: int = 0
    metric: str = "cosine"
    columns: tuple[str, ...] = ()

    @property
    def spark(self) -> T.DataType:
        one = T.ArrayType(T.FloatType()) if self.base == "Vector" else SCALARS[self.base]
        return T.ArrayType(one) if self.many else one

    @property
    def plain_text(self) -> bool:
        """A String without unit, the only kind that discovery searches unasked."""
        return self.base == "String" and not self.many and self.unit is None

    @property
    def number(self) -> bool:
        return self.base in ("Int", "Float") and not self.many

    def same_kind(self, other: Field) -> bool:
        return (self.base, self.many, self.dim) == (other.base, other.many, other.dim)

    def written(self) -> str:
        inner = f"Vector<{self.dim}, {self.metric}>" if self.base == "Vector" else self.base + (f"<{self.unit}>" if self.unit else "")
        inner += "[]" * self.many
        inner = f"<{inner}>" if self.temporal else inner
        return f"{self.name}{'?' * self.optional}: {inner}" + (f" from ({', '.join(self.columns)})" if self.columns else "")


@dataclass(frozen=True)
class Edge:
    """A relationship of ``kind`` as seen from one type; ``out`` if it leaves that type."""

    name: str
    kind: str
    out: bool
    targets: tuple[str, ...]
    many: bool
    temporal: bool = False
    props: dict[str, Field] = field(default_factory=dict, hash=False)

    def written(self) -> str:
        to = self.targets[0] if len(self.targets) == 1 else f"({' | '.join(self.targets)})"
        to += "[]" * self.many
        to = f"<{to}>" if self.temporal else to
        props = " { " + " ".join(p.written() for p in self.props.values()) + " }" if self.props else ""
        kind = f": {self.kind}" if self.kind != self.name else ""
        return f"{self.name}{kind} {'->' if self.out else '<-'} {to}{props}"


@dataclass(frozen=True)
class NodeType:
    name: str
    fields: dict[str, Field] = field(default_factory=dict, hash=False)
    edges: dict[str, Edge] = field(default_factory=dict, hash=False)
    appears: str | None = None
    ends: str | None = None
    period: tuple[str, str, str] | None = None
    calendars: dict[str, str] = field(default_factory=dict, hash=False)

    def columns(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f.name, f.spark) for f in self.fields.values())])

    def written(self) -> str:
        lines = [f.written() for f in self.fields.values()] + [e.written() for e in self.edges.values()]
        lines += [f"appears at {self.appears}"] * bool(self.appears) + [f"ends at {self.ends}"] * bool(self.ends)
        lines += ["period from {} to {} named by {}".format(*self.period)] if self.period else []
        lines += [f"calendar {w} -> {t}" for w, t in self.calendars.items()]
        return f"type {self.name} {{\n" + "".join(f"  {x}\n" for x in lines) + "}\n"


@dataclass(frozen=True)
class Schema:
    types: dict[str, NodeType] = field(default_factory=dict, hash=False)
    unique: tuple[tuple[str, str], ...] = ()
    indexed: tuple[tuple[str, str], ...] = ()
    views: tuple[str, ...] = ()

    def type(self, name: str, source: str = "", at: int | None = None) -> NodeType:
        if name not in self.types:
            raise QueryError(f"there is no type {name}", source, at, nearest(name, self.types), len(name))
        return self.types[name]

    def kinds(self) -> dict[str, Edge]:
        """One edge for each kind, out of the type that declares it that way where one does."""
        out: dict[str, Edge] = {}
        for t in self.types.values():
            for e in t.edges.values():
                if e.kind not in out or (e.out and not out[e.kind].out):
                    out[e.kind] = e
        return out

    def ends(self, kind: str, out: bool) -> set[str]:
        """Types that may stand at the source (``out``) or target end of a kind."""
        found: set[str] = set()
        for t in self.types.values():
            for e in t.edges.values():
                if e.kind == kind:
                    found |= {t.name} if e.out == out else set(e.targets)
        return found

    def props_of(self, kind: str) -> dict[str, Field]:
        out: dict[str, Field] = {}
        for t in self.types.values():
            for e in t.edges.values():
                if e.kind == kind:
                    out |= e.props
        return out

    def temporal_kind(self, kind: str) -> bool:
        return any(e.temporal for t in self.types.values() for e in t.edges.values() if e.kind == kind)

    def rel_columns(self, kind: str) -> T.StructType:
        base = [T.StructField(c, T.LongType()) for c in ("rel_id", "src", "dst")]
        return T.StructType(base + [T.StructField(p.name, p.spark) for p in self.props_of(kind).values()])

    def lifetimes(self) -> bool:
        return any(t.appears or t.ends for t in self.types.values())

    def written(self) -> str:
        """The schema as text that parses back to it."""
        out = "schema {\n" + "".join(t.written() for t in self.types.values()) + "}\n"
        for word, pairs in (("unique", self.unique), ("index", self.indexed)):
            if pairs:
                names = list(dict.fromkeys(t for t, _ in pairs))
                out += f"{word} {{\n" + "".join(f"  {n} {{ {' '.join(f for t, f in pairs if t == n)} }}\n" for n in names) + "}\n"
        return out


def unified(schema: Schema) -> Schema:
    """Every edge with all properties and the time typing that its kind has anywhere."""
    types = {}
    for t in schema.types.values():
        edges = {n: replace(e, props=schema.props_of(e.kind), temporal=schema.temporal_kind(e.kind)) for n, e in t.edges.items()}
        types[t.name] = replace(t, edges=edges)
    return replace(schema, types=types)

"""The syntax tree of statements; ``at`` is a place in the text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# --- values ---------------------------------------------------------------


@dataclass(frozen=True)
class PointValue:
    lat: float
    lon: float


@dataclass(frozen=True)
class VectorValue:
    items: tuple[float, ...]


@dataclass(frozen=True)
class ColumnRef:
    """``$name``: a column of the row that a load binds."""

    name: str


@dataclass(frozen=True)
class DateValue:
    """A literal instant (UTC seconds), a bare year, or a named period."""

    seconds: int | None = None
    year: int | None = None
    word: str | None = None
    name: Any = None
    edge: str | None = None  # start | end
    at: int = 0


# --- conditions -----------------------------------------------------------


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Any
    at: int = 0


@dataclass(frozen=True)
class IdCompare:
    op: str
    value: int


@dataclass(frozen=True)
class Distance:
    field: str
    point: PointValue
    op: str = ""
    metres: float = 0.0
    at: int = 0


@dataclass(frozen=True)
class Box:
    field: str
    south_west: PointValue
    north_east: PointValue
    at: int = 0


@dataclass(frozen=True)
class Similarity:
    field: str
    vector: VectorValue
    op: str = ""
    score: float = 0.0
    at: int = 0


@dataclass(frozen=True)
class Step:
    rel: str
    low: int
    high: int
    condition: Any = None
    at: int = 0
    worded: bool = False


@dataclass(frozen=True)
class Chain:
    negated: bool
    start: str | None
    steps: tuple[Step, ...]
    end: str | None = None
    at: int = 0


@dataclass(frozen=True)
class Recorded:
    """``ever`` or ``always`` a condition, in a window if one is given."""

    always: bool
    condition: Any
    window: tuple[DateValue, DateValue] | None = None


@dataclass(frozen=True)
class Moment:
    """The first or last recorded instant of a condition, compared if ``op``."""

    last: bool
    condition: Any
    op: str = ""
    date: DateValue | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


# --- selections -----------------------------------------------------------


@dataclass(frozen=True)
class Prop:
    name: str
    alias: str
    at: int = 0


@dataclass(frozen=True)
class Builtin:
    """id, hops, score, detach, distance, similarity, moment or series."""

    what: str
    alias: str
    arg: Any = None
    at: int = 0


@dataclass(frozen=True)
class EdgeProp:
    name: str
    alias: str
    value: Any = None
    sets: bool = False
    at: int = 0


@dataclass(frozen=True)
class PathSpec:
    bound: tuple[str, str, float] | None = None  # hops | cost, operator, most
    weight: str | None = None
    toward: str | None = None


@dataclass(frozen=True)
class Walk:
    field: str
    out: bool
    target: Selection
    alias: str
    low: int = 1
    high: int = 1
    ranged: bool = False
    path: PathSpec | None = None
    link: bool = False
    unlink: bool = False
    at: int = 0


@dataclass(frozen=True)
class Near:
    field: str
    vector: VectorValue
    k: int
    exact: bool = False


@dataclass(frozen=True)
class OrderKey:
    by: Any  # a field name or a Distance
    descending: bool = False


@dataclass(frozen=True)
class Window:
    changes: bool
    start: DateValue
    stop: DateValue


@dataclass(frozen=True)
class Selection:
    types: tuple[str, ...]
    condition: Any = None
    items: tuple = ()
    near: Near | None = None
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    window: Window | None = None
    assigns: tuple[tuple[str, Any], ...] = ()
    sets: tuple[tuple[str, Any], ...] = ()
    at: int = 0

    @property
    def says_one(self) -> bool:
        """Only equality tests joined by &&: the selection names one node."""
        if self.near or self.order or self.limit is not None or self.condition is None or self.window:
            return False
        parts = self.condition.parts if isinstance(self.condition, And) else (self.condition,)
        return all(isinstance(p, (Compare, IdCompare)) and p.op == "=" for p in parts)


# --- statements -----------------------------------------------------------


@dataclass(frozen=True)
class TextSearch:
    op: str
    needle: str
    fields: tuple[str, ...] = ()
    at: int = 0


@dataclass(frozen=True)
class Common:
    groups: tuple[tuple[str, tuple[str, ...]], ...]
    at: int = 0


@dataclass(frozen=True)
class Similar:
    field: str
    strict: bool
    score: float
    at: int = 0


@dataclass(frozen=True)
class Close:
    field: str
    strict: bool
    metres: float
    at: int = 0


@dataclass(frozen=True)
class Stage:
    condition: Any
    skip: bool = False


@dataclass(frozen=True)
class Query:
    root: Selection | None
    as_of: DateValue | None = None
    series: tuple[DateValue, DateValue, str] | None = None
    window: Window | None = None
    stages: tuple[Stage, ...] = ()
    skip: bool = False


@dataclass(frozen=True)
class Delete:
    selection: Selection


@dataclass(frozen=True)
class Mutation:
    statements: tuple
    at_date: DateValue | None = None
    source: str | None = None  # csv | json
    locations: tuple[str, ...] = ()


@dataclass(frozen=True)
class Document:
    schema: Any = None
    statements: tuple = field(default_factory=tuple)

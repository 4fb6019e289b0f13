"""Named dates: bare years, seasons and other periods, to UTC seconds.

A period is an ordinary node; its name is looked up with one small job.  A
bare year is the calendar year, whatever calendars there are.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dates
from . import syntax as X
from .errors import QueryError


def year_name(text: str, source: str = "", at=None) -> int:
    """26, 2026 and 26-27 (consecutive) are 2026."""
    m = re.fullmatch(r"(\d{2}|\d{4})(?:-(\d{2}|\d{4}))?", str(text))
    if not m:
        raise QueryError(f"{text} is no year of a period", source, at)
    full = lambda x: int(x) + (2000 if len(x) == 2 else 0)
    first = full(m[1])
    if m[2] and full(m[2]) != first + 1:
        raise QueryError(f"{text} does not span consecutive years", source, at)
    return first


def lookup(graph, types, d: X.DateValue, source: str = "") -> tuple[int, int]:
    """Start and end of a named period, by the calendar of the type that uses it."""
    owner = next((t for t in types if d.word in graph.schema.types[t].calendars), None)
    if owner is None:
        raise QueryError(f"{types[0]} has no calendar {d.word}", source, d.at, f"declare `calendar {d.word} -> Type`")
    name = graph.schema.types[owner].calendars[d.word]
    kind = graph.schema.types[name]
    starts, ends, named = kind.period
    value = year_name(d.name, source, d.at) if kind.fields[named].base == "Int" else d.name
    rows = graph.node(name).filter(F.col(named) == F.lit(value)).select(F.col(starts).cast("long").alias("a"), F.col(ends).cast("long").alias("b")).limit(2).collect()
    if not rows:
        raise QueryError(f"no {d.word} {value} in {name}", source, d.at, f"create a {name} node with its dates")
    if len(rows) > 1:
        raise QueryError(f"{d.word} {value} names more than one {name}", source, d.at)
    a, b = rows[0]
    if a is None or b is None or a > b:
        raise QueryError(f"{d.word} {value} has no valid dates", source, d.at)
    return a, b


def instant(graph, types, d: X.DateValue, last: bool = False, source: str = "") -> int:
    """One instant; ``last`` takes the end of a year or period that is not said to start or end."""
    if d.seconds is not None:
        return d.seconds
    if d.year is not None:
        return dates.year_bounds(d.year)[1 if last else 0]
    a, b = lookup(graph, types, d, source)
    return {"start": a, "end": b}.get(d.edge, b if last else a)


def overlapping(graph, types, word: str, start: int, stop: int) -> list[int]:
    """Starts of the periods of a calendar that overlap a range, in order."""
    owner = next(t for t in types if word in graph.schema.types[t].calendars)
    name = graph.schema.types[owner].calendars[word]
    starts, ends, _ = graph.schema.types[name].period
    rows = graph.node(name).select(F.col(starts).cast("long").alias("a"), F.col(ends).cast("long").alias("b")).filter((F.col("a") <= stop) & (F.col("b") >= start)).orderBy("a").collect()
    return [r.a for r in rows]

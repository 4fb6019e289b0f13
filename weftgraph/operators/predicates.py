"""Tests of one node as columns, under two-valued logic.

A test on a missing value is false; ``!=`` on it is true.  Values of
different kinds are never cast to each other: such a comparison is false
(``!=``: true), decided from the declared type before Spark sees it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, geo, text, vectors
from ..plans import syntax as X
from ..plans.schema import Field


def text_test(c: Column, op: str, needle: str) -> Column:
    """Exact or folded substring, prefix, suffix, or a regular expression."""
    if op == "regex":
        return c.rlike(text.spark_regex(needle))
    if op.endswith("Like"):
        c, needle = text.folded(c), text.fold(needle)
    if op.startswith("find"):
        return c.contains(F.lit(needle))
    return c.startswith(F.lit(needle)) if op.startswith("starts") else c.endswith(F.lit(needle))


def literal(value, field: Field) -> Column | None:
    """The value as a column of the field's type; None if it is of another kind."""
    if value is None:
        return F.lit(None).cast(field.spark)
    if field.many:
        if not isinstance(value, tuple):
            return None
        one = Field(field.name, field.base, unit=field.unit, dim=field.dim)
        parts = [literal(v, one) for v in value]
        return None if any(p is None for p in parts) else F.array(*parts).cast(field.spark)
    if field.base == "Bool":
        return F.lit(value) if isinstance(value, bool) else None
    if field.base in ("Int", "Float"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        return F.lit(value) if not isinstance(value, int) or abs(value) < 2**63 else F.lit(float(value))
    if field.base == "Date":
        seconds = dates.parse_date(value) if isinstance(value, str) else None
        return None if seconds is None else dates.instant(seconds)
    if field.base == "Point":
        return F.struct(F.lit(value.lat).alias("lat"), F.lit(value.lon).alias("lon")) if isinstance(value, X.PointValue) else None
    if field.base == "Vector":
        return vectors.literal(value.items) if isinstance(value, X.VectorValue) else None
    return F.lit(value) if isinstance(value, str) else None


def _ordered(field: Field, c: Column, op: str, v: Column) -> Column:
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def compare(test: X.Compare, field: Field | None, c: Column) -> Column:
    """One field against one value."""
    if test.op not in ("=", "!=", "<", "<=", ">", ">="):
        ok = field is not None and field.base in ("String", "Reference") and not field.many
        return F.coalesce(text_test(c, test.op, test.value), F.lit(False)) if ok else F.lit(False)
    value = literal(test.value, field) if field is not None else None
    if test.op in ("=", "!="):
        if value is None or (field.base == "Int" and isinstance(test.value, float)):
            same = F.lit(False)
        else:
            same = c.eqNullSafe(value)
        return same if test.op == "=" else ~same
    if value is None or test.value is None or field.many or field.base in ("Bool", "Point", "Vector"):
        return F.lit(False)
    return F.coalesce(_ordered(field, c, test.op, value), F.lit(False))


def measured(test, field: Field, c: Column) -> Column:
    """Radius, box and similarity tests."""
    if isinstance(test, X.Box):
        a, b = test.south_west, test.north_east
        return F.coalesce(geo.in_box(c, a.lat, a.lon, b.lat, b.lon), F.lit(False))
    if isinstance(test, X.Distance):
        p = test.point
        if test.op in ("<", "<="):
            return F.coalesce(geo.within(c, p.lat, p.lon, test.metres, test.op == "<"), F.lit(False))
        d = geo.distance(c, p.lat, p.lon)
        return F.coalesce(d > test.metres if test.op == ">" else d >= test.metres, F.lit(False))
    score = vectors.score(c, vectors.literal(test.vector.items), field.metric)
    return F.coalesce(_ordered(field, score, test.op, F.lit(test.score)), F.lit(False))

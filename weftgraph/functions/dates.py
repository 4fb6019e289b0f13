"""Instants as UTC seconds and as timestamp columns."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three accepted forms: a day, a minute, a second.
DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}))?)?")
COLUMN_FORMS = (("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd"), ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}$", "yyyy-MM-dd'T'HH:mm"), ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"))


def parse_date(text: str) -> int | None:
    """UTC seconds of a date in an accepted form, else None."""
    m = DATE.fullmatch(text)
    if not m:
        return None
    try:
        return int(datetime(*(int(x or 0) for x in m.groups()), tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def format_date(seconds: int) -> str:
    """The canonical text; seconds only where they are not zero."""
    d = datetime.fromtimestamp(seconds, timezone.utc)
    return d.strftime("%Y-%m-%dT%H:%M:%S" if d.second else "%Y-%m-%dT%H:%M")


def year_bounds(year: int) -> tuple[int, int]:
    """First and last second of a calendar year."""
    start = calendar.timegm((year, 1, 1, 0, 0, 0))
    return start, calendar.timegm((year + 1, 1, 1, 0, 0, 0)) - 1


def instant(seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(seconds))


def dated(text: Column) -> Column:
    """Timestamp of a text column in an accepted form, else null."""
    out = F.lit(None).cast("timestamp")
    for shape, form in COLUMN_FORMS:
        out = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))).otherwise(out)
    return out


def dated_text(ts: Column) -> Column:
    """The canonical text of a timestamp column (session time zone UTC)."""
    return F.when(F.second(ts) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))


def samples(start: int, stop: int, unit: str) -> list[int]:
    """Instants from ``start`` through ``stop``: every 24 hours, 7 days, or the first of the following months."""
    out, t = [], start
    while t <= stop:
        out.append(t)
        if unit == "month":
            d = datetime.fromtimestamp(t, timezone.utc)
            t = calendar.timegm((d.year + d.month // 12, d.month % 12 + 1, 1, 0, 0, 0))
        else:
            t += 86400 * (7 if unit == "week" else 1)
    return out

"""The registry of queries and their SQL, with what several modules of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.tables import shop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY_VECTOR = [1.0] + [0.25] * 63
HISTORY = "h AS (SELECT user_id, date_trunc('second', ts) AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events)"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(shop(spark, sf_dir))


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def flat(name: str, text: str, sql: str) -> None:
    """A statement whose flat rows are the result."""
    QUERIES[name] = lambda spark, sf_dir: plain(engine(spark, sf_dir).flat(text))
    SQL[name] = sql


def query(sql: str | None = None, name: str | None = None):
    def registered(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return registered

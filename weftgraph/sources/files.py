"""Rows of CSV and JSON sources as DataFrames of source columns.

CSV columns stay text: a cell's type is decided where a template binds it.
JSON keeps its own types.  ``_row`` numbers the records in file order.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError


def _headers(names: list[str]) -> list[str]:
    names = [n.strip() for n in names]
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise QueryError("each csv column needs a name of its own")
    return names


def csv_text(spark: SparkSession, text: str) -> DataFrame:
    """A CSV source that the caller holds as text."""
    records = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"))) if r]
    if not records:
        raise QueryError("csv has no header")
    names = _headers(records[0])
    for n, r in enumerate(records[1:], 2):
        if len(r) != len(names):
            raise QueryError(f"invalid csv: record {n} has {len(r)} fields, the header {len(names)}")
    schema = T.StructType([T.StructField("_row", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(records[1:])], schema)


def csv_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of any size, read by Spark; malformed records are an error."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise QueryError("csv has no header")
    names = _headers(next(csv.reader([head[0].value])))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False, emptyValue="")
    return df.withColumn("_row", F.monotonically_increasing_id())


def json_text(spark: SparkSession, text: str) -> DataFrame:
    """A JSON object, or an array of objects, that the caller holds as text."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise QueryError(f"invalid json: {e}") from None
    rows = found if isinstance(found, list) else [found]
    if any(not isinstance(r, dict) for r in rows):
        raise QueryError("json is an object or an array of objects")
    lines = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    base = spark.createDataFrame(lines, "_row bigint, _json string")
    names = list(dict.fromkeys(k for r in rows for k in r))
    inferred = spark.read.json(base.select("_json").rdd.map(lambda r: r[0])).schema if rows else T.StructType([])
    if not names:
        return base.select("_row")
    return base.select("_row", F.from_json("_json", inferred).alias("x")).select("_row", "x.*")


def json_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).withColumn("_row", F.monotonically_increasing_id())


def open_source(spark: SparkSession, kind: str, location: str, sources: dict[str, str] | None = None) -> DataFrame:
    """A source by its location: text that the host supplies, else a path that Spark reads."""
    if sources is not None:
        if location not in sources:
            raise QueryError(f"no source was supplied for {location}")
        return (csv_text if kind == "csv" else json_text)(spark, sources[location])
    if ".." in location.replace("\\", "/").split("/"):
        raise QueryError(f"{location}: a path may not contain ..")
    if location.startswith(("http://", "https://")):
        raise QueryError(f"{location}: fetch it first and pass its text as a source")
    return (csv_file if kind == "csv" else json_file)(spark, location)


def preview(spark: SparkSession, kind: str, location: str, rows: int = 20, sources: dict[str, str] | None = None) -> DataFrame:
    """The first rows of a source, nothing inserted (a limit by its nature)."""
    return open_source(spark, kind, location, sources).orderBy("_row").limit(rows).drop("_row")

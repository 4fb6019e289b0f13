"""Change data: a log of versions, coalesced windows, mirrors with gap checks.

A change is ``version, node_id, op, fields, added, removed``: the fields that a
version gave a node (a map to JSON text), and relationship ids that it gained
and lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "version bigint, node_id bigint, op string, fields map<string,string>, added array<bigint>, removed array<bigint>"
WINDOW = "5 seconds"


def since(log: DataFrame, version: int) -> DataFrame:
    """The changes after a version."""
    return log.filter(F.col("version") > version)


def of_engine(engine) -> DataFrame:
    """The engine's own log as changes."""
    spark: SparkSession = engine.spark
    out = spark.createDataFrame([], CHANGE)
    none = F.array().cast("array<bigint>")
    for version, log in engine.changes:
        for c in log:
            v = F.lit(version).cast("bigint").alias("version")
            if c.op in ("link", "unlink"):
                one = F.array("rel_id")
                ends = c.rows.select("rel_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
                rows = ends.select(v, "node_id", F.lit(c.op).alias("op"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"), (one if c.op == "link" else none).alias("added"), (none if c.op == "link" else one).alias("removed"))
            else:
                names = [n for n in c.rows.columns if n != "id"]
                pairs = [x for n in names for x in (F.lit(n), F.to_json(F.array(F.col(n))))]
                held = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
                rows = c.rows.select(v, F.col("id").alias("node_id"), F.lit(c.op).alias("op"), held.alias("fields"), none.alias("added"), none.alias("removed"))
            out = out.unionByName(rows)
    return out


def coalesced(changes: DataFrame) -> DataFrame:
    """One change for each node of a window: last value of each field, additions and removals cancelled.

    A relationship that comes and goes within the window leaves no trace; one
    that went and came back stays added.  Everything is a grouped maximum, so
    map sides combine.
    """
    last = changes.groupBy("node_id").agg(F.max("version").alias("version"), F.max_by("op", "version").alias("op"))
    each = changes.select("node_id", "version", F.explode("fields").alias("k", "v")).groupBy("node_id", "k").agg(F.max_by("v", "version").alias("v"))
    fields = each.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
    moves = changes.select("node_id", "version", F.explode("added").alias("rel"), F.lit(1).alias("d")).unionAll(changes.select("node_id", "version", F.explode("removed").alias("rel"), F.lit(-1).alias("d")))
    moves = moves.groupBy("node_id", "rel").agg(F.max_by("d", "version").alias("last"), F.sum("d").alias("net")).filter("net <> 0")
    listed = lambda d: F.array_sort(F.collect_list(F.when(F.col("last") == d, F.col("rel"))))
    moves = moves.groupBy("node_id").agg(listed(1).alias("added"), listed(-1).alias("removed"))
    none = F.array().cast("array<bigint>")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = last.join(fields, "node_id", "left").join(moves, "node_id", "left")
    return out.select("version", "node_id", "op", F.coalesce("fields", nothing).alias("fields"), F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed"))


def windows(stream: DataFrame, at: str = "at", window: str = WINDOW, late: str = "1 minute") -> DataFrame:
    """Per window and node, the latest version and field map of a change stream."""
    watched = stream.withWatermark(at, late)
    return watched.groupBy(F.window(at, window), "node_id").agg(F.max("version").alias("version"), F.max_by("fields", "version").alias("fields"), F.count(F.lit(1)).alias("n"))


def mirror(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, gaps) of a mirror that applies versioned records per key.

    ``state`` and ``batch`` have ``key, version, payload``.  Older versions
    are ignored, the next ones applied in turn; where one is missing, the
    mirror stops before it and the key is a gap to fetch again.
    """
    from pyspark.sql import Window

    have = state.select("key", F.col("version").alias("have"))
    fresh = batch.dropDuplicates(["key", "version"]).join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("version") > F.col("have"))
    w = Window.partitionBy("key").orderBy("version")
    fresh = fresh.withColumn("due", F.col("have") + F.row_number().over(w)).withColumn("ok", F.col("version") == F.col("due"))
    good = fresh.filter("ok").groupBy("key").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))
    gaps = fresh.filter("not ok").groupBy("key").agg(F.min("due").alias("missing"))
    rest = state.join(good.select("key"), "key", "left_anti")
    return rest.unionByName(good.select(*state.columns)), gaps


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A change log written as Parquet, as a stream."""
    return spark.readStream.schema(CHANGE).parquet(path)

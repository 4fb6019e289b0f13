"""Tables in the folder that the driver and all executors share.

Loops over DataFrames cut their lineage here: a written table outlives lost
executors, a cached or locally checkpointed one does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder in a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir().get()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` to be joined by merging: loops that broadcast in each round send the driver a multiple of their tables."""
    return df.hint("merge")


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; no more than that are counted."""
    return df.limit(rows + 1).count() <= rows


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)

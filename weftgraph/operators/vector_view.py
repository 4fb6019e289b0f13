"""Views of vectors: principal axes, and which links the vectors agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import discovery


def principal_axes(rows: DataFrame, k: int = 3) -> DataFrame:
    """``id, axes``: places of vectors (id, v) on their first ``k`` principal axes.

    Centred; an axis points where its component of greatest size (the first
    of equals) is positive.  The covariance is summed by a tree of partial
    sums; only a dim x dim matrix reaches the driver.  Missing axes are 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    held = rows.filter(F.col("v").isNotNull()).select("id", vectors.doubles(F.col("v")).alias("v"))
    first = held.select(F.size("v").alias("d")).first()
    if first is None:
        return held.select("id", F.array().cast("array<double>").alias("axes"))
    dim = first.d
    df = held.withColumn("x", array_to_vector("v"))
    mean = df.select(Summarizer.mean(F.col("x"))).first()[0].toArray()
    axes = PCA(k=min(k, dim), inputCol="x", outputCol="y").fit(df).pc.toArray().T
    shown = []
    for a in axes:
        i = int(abs(a).argmax())
        a = -a if a[i] < 0 else a
        shift = float((a * mean).sum())
        shown.append(vectors._sum(F.zip_with("v", F.array(*[F.lit(float(x)) for x in a]), lambda p, q: p * q)) - F.lit(shift))
    shown += [F.lit(0.0)] * (k - len(shown))
    return held.select("id", F.array(*shown).alias("axes"))


def links_and_meaning(rows: DataFrame, links: DataFrame, threshold: float, metric: str, dim: int) -> DataFrame:
    """``from, to, score, linked, alike`` of pairs that are linked, or similar, or both.

    ``links`` has src and dst; direction does not matter here.
    """
    ids = rows.select("id")
    own = links.select(F.least("src", "dst").alias("from"), F.greatest("src", "dst").alias("to")).filter("`from` <> `to`").distinct()
    own = own.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    a = rows.select(F.col("id").alias("from"), F.col("v").alias("va"))
    b = rows.select(F.col("id").alias("to"), F.col("v").alias("vb"))
    linked = own.join(a, "from").join(b, "to").select("from", "to", vectors.score(F.col("va"), F.col("vb"), metric).alias("score"))
    alike = discovery.similar_pairs(rows, threshold, metric, dim, False)
    both = linked.withColumn("linked", F.lit(True)).withColumn("alike", F.lit(False)).unionByName(alike.withColumn("linked", F.lit(False)).withColumn("alike", F.lit(True)))
    return both.groupBy("from", "to").agg(F.max("score").alias("score"), F.bool_or("linked").alias("linked"), F.bool_or("alike").alias("alike"))


def nearest(rows: DataFrame, chosen: int, k: int, metric: str) -> DataFrame:
    """``id, score`` of the ``k`` vectors nearest to that of one node."""
    one = rows.filter(F.col("id") == chosen).select(F.col("v").alias("w")).limit(1)
    met = rows.filter((F.col("id") != chosen) & F.col("v").isNotNull()).crossJoin(F.broadcast(one))
    return met.select("id", vectors.score(F.col("v"), F.col("w"), metric).alias("score")).orderBy(F.desc("score"), "id").limit(k)

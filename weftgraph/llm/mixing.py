"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words.  Sources, by code point with null
last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all sizes; a target
stops at 3 times its source's size and the excess is shared again by weight.

For each source, its documents are counted by exact size.  The target is met
by whole passes over the source, then by documents taken once more: an even
share of every size, in a seeded order in which what rounding leaves of one
size is dealt with the next, up to a few times the largest size or a part of
``DP_WORDS`` before the budget, and for what is left a bounded-knapsack dynamic programme over all counts that remain (every sum up
to what is left, with the step that reached it).  The same for the documents left out gives the nearest sum above; the
nearer one is taken.  Which documents of a size are taken is drawn by a seeded
hash: the plan says how many, a hash bucket's place tells which.  A size of c
documents has about sqrt(c) buckets, so no group is ranked as a whole, and
the plan is broadcast up to ``PLAN_ROWS`` rows and salted beyond, so no size
meets it in one task.

The driver sees one row for each source; a task holds the distinct sizes of
one source.

Null and empty texts have size 0 and are never taken (their words are 0).  A
source of size 0 has target 0.  Repeated rows are documents of their own,
except that identical rows are interchangeable.  An empty table gives none.  Other
columns, whatever their names, are not read; ``mixture`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CYCLE = (1, 2, 3)
MOST = 3
DP_WORDS = 60_000  # least width of the programme; it grows with the largest size
SALTS = 16
PLAN_ROWS = 100_000  # (source, size) pairs that are broadcast, about 10 MB


def targets_for(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size."""
    total = float(sum(sizes))
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes)], total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            return out
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def fit(counts: dict[int, int], budget: int, seed: int = 0, dp_words: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each size to take so that sizes sum to ``budget``.

    The sum never exceeds the budget; what is left of it when all sizes but
    the last few documents are settled is met as nearly as those allow.
    """
    import random

    import numpy as np

    total = sum(s * c for s, c in counts.items())
    if budget <= 0 or not total:
        return {}
    budget = min(budget, total)
    sizes = sorted(s for s in counts if s > 0)
    draw = random.Random(seed)
    draw.shuffle(sizes)
    most = max(dp_words, 4 * max(sizes))
    even = budget - most * 3 // 4 if budget > most else 0  # what is dealt evenly; the programme meets the rest
    take, due = {}, 0.0
    for s in sizes:  # what rounding leaves of a size is dealt with the next
        due += s * counts[s] * even / total
        take[s] = min(counts[s], max(0, round(due / s)))
        due -= s * take[s]
    left = budget - sum(s * k for s, k in take.items())
    for s in sizes:  # until the programme can hold what is left
        if left <= most:
            break
        k = min(counts[s] - take[s], (left - most // 2) // s)
        take[s] += k
        left -= k * s
    reached, step_of, steps = np.zeros(left + 1, bool), np.zeros(left + 1, np.int32), []
    reached[0] = True
    for s in sizes:
        spare, piece = min(counts[s] - take[s], left // s), 1
        while spare > 0 and not reached[left]:
            k = min(piece, spare)
            new = np.flatnonzero(reached[: left + 1 - s * k] & ~reached[s * k :]) + s * k
            step_of[new] = len(steps)
            reached[new] = True
            steps.append((s, k))
            spare, piece = spare - k, piece * 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:  # a sum's step builds on a sum of an earlier step
        s, k = steps[step_of[at]]
        take[s] += k
        at -= s * k
    return {s: k for s, k in take.items() if k}


def nearest(counts: dict[int, int], budget: int, seed: int = 0, dp_words: int = DP_WORDS) -> dict[int, int]:
    """Like ``fit``, or above the budget where that comes nearer to it.

    The least sum above is what the best fit of the rest leaves over.
    """
    total = sum(s * c for s, c in counts.items())
    below = fit(counts, budget, seed, dp_words)
    if not 0 < budget < total:
        return below
    left_over = fit(counts, total - budget, seed, dp_words)
    above = {s: c - left_over.get(s, 0) for s, c in counts.items() if s > 0 and c > left_over.get(s, 0)}
    size = lambda take: sum(s * k for s, k in take.items())
    return above if size(above) - budget < budget - size(below) else below


def _draw(seed: int):
    """The seeded hash of a row; equal for identical rows only."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"), F.coalesce("source", F.lit("")), F.col("doc_id").isNull(), F.col("source").isNull(), F.lit(seed))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, draw`` for each row."""
    return docs.select("doc_id", "source", common.word_count(docs["text"]).alias("size"), _draw(seed).alias("draw"))


def _plan(measured: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources: source, source_size, target, no), (plan: no, size, c, passes, extra)."""
    spark = measured.sparkSession
    histogram = common.staged(measured.groupBy("source", "size").agg(F.count(F.lit(1)).alias("c")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    found = sorted(((r.source, r.source_size) for r in sizes.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goals = targets_for([s for _, s in found], [CYCLE[i % len(CYCLE)] for i in range(len(found))])
    rows = [(k, int(s), float(g)) for (k, s), g in zip(found, goals)]
    sources = spark.createDataFrame(rows, f"source {measured.schema['source'].dataType.simpleString()}, source_size long, target double")

    def planned(key, part):
        import pandas as pd

        whole, goal = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = min(MOST, int(goal // whole)) if whole else 0
        counts = {int(s): int(c) for s, c in zip(part["size"], part["c"])}
        extra = nearest(counts, round(goal) - passes * whole, seed) if passes < MOST else {}
        sizes = sorted(counts)
        return pd.DataFrame({"no": key[0], "size": sizes, "c": [counts[s] for s in sizes], "passes": passes, "extra": [extra.get(s, 0) for s in sizes]})

    numbered = sources.withColumn("no", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    joined = histogram.join(F.broadcast(numbered) if len(rows) <= 100_000 else numbered, histogram["source"].eqNullSafe(numbered["source"]))
    plan = joined.select("no", "size", "c", "source_size", "target").groupBy("no").applyInPandas(planned, "no long, size long, c long, passes int, extra long")
    return numbered, common.staged(plan, "plan")


def mixed(docs: DataFrame, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row.

    ``copies`` says how often the mix takes the document, ``taken`` is
    ``copies * size``.
    """
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))
    measured = common.staged(_measured(picked, seed), "measured")
    sources, plan = _plan(measured, seed)
    few = size_few(sources)
    rows = measured.join(F.broadcast(sources) if few else sources, measured["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "draw", "source_size", "target", "no")
    few_sizes = common.size_at_most(plan, PLAN_ROWS)
    return _chosen(_met(rows, plan, few_sizes), few_sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "draw")


def size_few(sources: DataFrame) -> bool:
    return common.size_at_most(sources, 100_000)


def _met(rows: DataFrame, sizes: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row for each (no, size).

    Few rows (checked) are broadcast; more are shuffled once for each salt, so
    that a size that very many documents have is not one task's.  Exploded
    rows are never broadcast, whatever the planner thinks of their size.
    """
    if few:
        return rows.join(F.broadcast(sizes), ["no", "size"], how)
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int")).join(salted, ["no", "size", "salt"], how).drop("salt")


def _chosen(rows: DataFrame, few: bool) -> DataFrame:
    """``copies``: the passes, and one more for the ``extra`` least draws of a size.

    The draw of the last document taken lies in one bucket of draws; buckets
    are counted first and only that bucket is ranked.
    """
    bits = F.greatest(F.ceil(F.log2("c") / 2), F.lit(1)).cast("int")
    rows = rows.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("draw"), 64 - bits))
    counted = rows.filter("extra > 0").groupBy("no", "size", "bucket").agg(F.count(F.lit(1)).alias("here"), F.first("extra").alias("wanted"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counted.withColumn("before", before).filter("before < wanted and before + here >= wanted").select("no", "size", F.col("bucket").alias("cut"), (F.col("wanted") - F.col("before")).alias("rest"))
    rows = _met(rows, cut, few, "left")
    edge = rows.filter("bucket = cut").withColumn("rank", F.row_number().over(Window.partitionBy("no", "size").orderBy("draw", "doc_id")))
    edge = edge.select(*rows.columns, (F.col("rank") <= F.col("rest")).cast("int").alias("more"))
    other = rows.filter("cut is null or bucket <> cut").withColumn("more", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int"))
    return other.unionByName(edge).withColumn("copies", (F.col("passes") + F.when(F.col("size") > 0, F.col("more")).otherwise(0)).cast("long"))


def mixture(docs: DataFrame, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = mixed(docs, seed, id_col, text_col, source_col)
    copies = copies.groupBy("doc_id", "draw").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("m")).filter("all > 0")
    copies = common.staged(copies.select(F.col("doc_id").alias("_id"), F.col("draw").alias("_draw"), "all", "m"), "copies")
    picked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))
    keyed = picked.select("_row", "doc_id", _draw(seed).alias("_key"))
    met = keyed.join(copies, (keyed["_key"] == copies["_draw"]) & keyed["doc_id"].eqNullSafe(copies["_id"])).select("_row", "_key", "_id", "all", "m")
    one = met.filter("m = 1").select("_row", F.col("all").alias("k"))
    twin = met.filter("m > 1").withColumn("rank", F.row_number().over(Window.partitionBy("_key", "_id").orderBy("all")))
    more = (F.col("rank") <= F.expr("all % m")).cast("long")
    twin = twin.select("_row", (F.expr("all div m") + more).alias("k"))
    rows = one.unionByName(twin).filter("k > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("k").cast("int")))).select("_row.*")

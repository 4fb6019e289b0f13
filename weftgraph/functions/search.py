"""Ranked text search: BM25 with grouped statistics, and edit distances.

A page is a title and a body; title tokens weigh more.  All statistics are
aggregations over all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ranking.
K1, B, TITLE_WEIGHT = 1.2, 0.75, 3
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def bm25(pages: DataFrame, terms: list[str], title_weight: int = TITLE_WEIGHT, k1: float = K1, b: float = B) -> DataFrame:
    """``id, score`` of the pages (id, title, body) that hold one of ``terms``.

    Only the counts of the terms leave a page, so what is shuffled are the
    matches; lengths and frequencies are two aggregations over one scan.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    title, body = tokens(F.col("title")), tokens(F.col("body"))
    held = pages.select("id", title.alias("t"), body.alias("b"))

    def times(word):
        same = lambda x: x == word
        return F.size(F.filter("t", same)) * title_weight + F.size(F.filter("b", same))

    counts = [times(F.lit(t)).cast("long").alias(f"c{i}") for i, t in enumerate(terms)]
    rows = held.select("id", (F.size("t") * title_weight + F.size("b")).cast("long").alias("len"), *counts)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"c{i}")
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))).otherwise(0.0)
    met = F.lit(False)
    for i in range(len(terms)):
        met = met | (F.col(f"c{i}") > 0)
    return rows.filter(met).join(F.broadcast(totals)).select("id", score.alias("score"))


def damerau(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words."""
    last, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if last is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last[j - 2] + 1)
            now.append(best)
        last, row = row, now
    return row[-1]


def close_words(words: DataFrame, query: str, most: int) -> DataFrame:
    """``word, edits`` of distinct words within ``most`` edits of ``query``.

    Plain edit distance bounds the other from both sides (a swap is two plain
    edits), so only words that it leaves in doubt reach Python.
    """

    def edits(s):
        return s.map(lambda w: damerau(query, w)).astype("int32")

    plain = F.levenshtein(F.col("word"), F.lit(query))
    near = words.select("word").distinct().filter((F.abs(F.length("word") - len(query)) <= most) & (plain <= 2 * most))
    exact = F.pandas_udf(edits, "int")
    return near.select("word", exact("word").alias("edits")).filter(F.col("edits") <= most)


def acronym(text: Column) -> Column:
    """Upper-case first letters of the words."""
    return F.upper(F.array_join(F.transform(tokens(text), lambda w: F.substring(w, 1, 1)), ""))

"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Folding.  Letters are lower-cased and, but for the accented letters that the
corpus' languages spell with, stripped of accents; look-alikes of other scripts, full-width forms, digits and signs that stand for letters
become those letters; zero-width characters go; all else separates words.

Lexicon.  Learned from labelled rows (a hash sample of at most ``most`` rows):
an entry is the start of a word (4 to 14 letters) or a whole word of any length
that occurs in toxic rows far more than in others.  Occurrences count once for each neighbourhood (word before, word
after), so copies of a row do not count again, and an entry must be too
frequent for chance.  Of starts with the same occurrences the longest is kept,
and a whole word only where no start of it is.  The labelled rows bound the lexicon, nothing else.
Exception phrases are pairs of a word under an entry and a neighbour that
occur in rows labelled clean only; a match inside one counts nothing.  Callers
may add phrases.

Score.  The weights of the matches over a power of the number of words that
is chosen, with a logistic curve, on the same labelled rows.  It depends on
the text alone.

Null and empty texts have no matches and get the curve's least score.  Without
labels of both kinds the lexicon is empty and every score is 0.  Repeated rows
are scored each; repeated labels of a row: any label 1 makes it toxic.  A very
long text is matched as a whole; other columns, whatever their names, are not
read; an empty table gives no row.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED_MOST = 20_000
SHORTEST, LONGEST = 4, 14  # of starts; whole words may have any length
POWERS = (0.25, 0.5, 0.75, 1.0)

_LOOK_ALIKE = dict(zip("авекмнорстухіјѕһԁԛԝɡαβειοκνρτυχγηωɑəıłøđħ", "abekmhopctyxijshdqwgabeiokvptuxynwaeilodh"))
_SPELT = set("äöüßéèêëçàâîïôûùñáíóú")
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i"}


def fold_table() -> dict[int, str | None]:
    """For ``str.translate``; every character of a folded text is a letter, another digit or a space."""
    out: dict[int, str | None] = {}
    for c in range(0x20000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(ch)
        lower = unicodedata.normalize("NFKC", ch).lower()
        plain = lower if lower in _SPELT else "".join(x for x in unicodedata.normalize("NFKD", ch).lower() if not unicodedata.combining(x))
        plain = plain.replace("æ", "ae").replace("œ", "oe")
        plain = "".join(_DIGITS.get(x, x) for x in (_LOOK_ALIKE.get(x, x) for x in plain))
        if kind in ("Mn", "Cf"):
            out[c] = None
        elif not plain or not all(x.isalnum() for x in plain):
            out[c] = " "
        elif plain != ch:
            out[c] = plain
    return out


class Folder(dict):
    def __init__(self):
        super().__init__(fold_table())

    def __call__(self, text: str | None) -> str:
        return text.translate(self) if text else ""


_FOLDER: list = []


def folder() -> Folder:
    if not _FOLDER:
        _FOLDER.append(Folder())
    return _FOLDER[0]


@dataclass
class Model:
    """Entries with their weights (a space at the end marks a whole word), exception phrases and the curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.5
    slope: float = 0.0
    bias: float = -30.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(f" {t}", (len(t) + 1, w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def matched(automaton, folded: str) -> tuple[float, int, int]:
    """(weight, matches, words) of a folded text."""
    words = folded.split()
    if not len(automaton) or not words:
        return 0.0, 0, len(words)
    best: dict[int, float] = {}
    excepted = []
    for end, (n, w) in automaton.iter(f" {' '.join(words)} "):
        start = end - n + 1
        if w is None:
            excepted.append((start, end))
        else:
            best[start] = max(w, best.get(start, w))
    if excepted:
        from bisect import bisect_right

        excepted.sort()
        firsts, reach = [a for a, _ in excepted], []
        for _, b in excepted:  # how far the phrases that began so far reach
            reach.append(max(b, reach[-1]) if reach else b)
        covered = lambda s: (k := bisect_right(firsts, s)) > 0 and s < reach[k - 1]
        best = {s: w for s, w in best.items() if not covered(s)}
    return sum(best.values()), len(best), len(words)


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic`` of at most about ``most`` labelled rows, drawn by hash."""
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > most:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return common.staged(docs.join(F.broadcast(labels), "doc_id").select("text", "toxic"), "labelled")


def _occurrences(sample: DataFrame) -> DataFrame:
    """``word, context, toxic`` of every folded word of the sample."""

    def made(batches):
        import pyarrow as pa
        import xxhash

        fold = folder()
        for b in batches:
            words, contexts, toxic = [], [], []
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                w = ["", *fold(text).split(), ""]
                seen = {(x, y, z) for x, y, z in zip(w, w[1:], w[2:])}
                for x, y, z in seen:
                    words.append(y)
                    contexts.append(xxhash.xxh3_64_intdigest(f"{x} {z}") >> 1)
                    toxic.append(int(label > 0))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic, pa.int32())], ["word", "context", "toxic"])

    return sample.mapInArrow(made, "word string, context long, toxic int")


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Word starts and whole words (with a space at the end) with their log odds."""
    import math

    once = _occurrences(sample).groupBy("word", "context").agg(F.max("toxic").alias("t"), F.min("toxic").alias("c"))
    words = common.staged(once.groupBy("word").agg(F.sum("t").alias("t"), F.sum(1 - F.col("c")).alias("c")), "words")
    all_t, all_c = (x or 0 for x in words.agg(F.sum("t"), F.sum("c")).first())
    if not all_t or not all_c:
        return {}
    begun = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    begun = F.when(F.length("word") >= SHORTEST, begun).otherwise(F.array().cast("array<string>"))
    starts = words.select(F.explode(F.concat(begun, F.array(F.concat("word", F.lit(" "))))).alias("start"), "t", "c")
    starts = starts.groupBy("start").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = all_t / (all_t + all_c)
    least = max(3, math.ceil(math.log(1e-9) / math.log(share)))
    odds = F.log((F.col("t") + 0.5) / (all_t + 1)) - F.log((F.col("c") + 0.5) / (all_c + 1))
    found = starts.withColumn("w", odds).filter((F.col("t") >= least) & (F.col("w") >= math.log(20)))
    by = {r.start: (r.t, r.w) for r in found.collect()}  # as many as labelled rows, which are bounded, can support
    longer = {q[:-1] for q in by if q[-1] != " " and q[:-1] in by and by[q][0] >= 0.9 * by[q[:-1]][0]}
    kept: dict[str, float] = {}
    for s in sorted(by, key=lambda s: (s[-1] == " ", len(s), s)):
        if s not in longer and not any(s[:n] in kept and kept[s[:n]] >= by[s][1] - 1 for n in range(SHORTEST, min(len(s), LONGEST + 1))):
            kept[s] = by[s][1]
    return kept


def _phrases(sample: DataFrame, terms: dict[str, float]) -> list[str]:
    """Pairs of words under an entry and a neighbour, in clean rows only."""
    if not terms:
        return []

    def made(batches):
        import pyarrow as pa

        fold = folder()
        for b in batches:
            out, toxic = [], []
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                w = fold(text).split()
                at = [i for i, x in enumerate(w) if f"{x} " in terms or any(x[:n] in terms for n in range(SHORTEST, min(len(x), LONGEST) + 1))]
                pairs = {f"{w[j]} {w[j + 1]}" for i in at for j in (i - 1, i) if 0 <= j < len(w) - 1}
                out += pairs
                toxic += [int(label > 0)] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int64())], ["phrase", "toxic"])

    counted = sample.dropDuplicates(["text"]).mapInArrow(made, "phrase string, toxic long").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    return [r.phrase for r in counted.filter("t = 0 and n >= 3").orderBy("phrase").collect()]


def _curve(rows: list[tuple[float, int, int]], model: Model) -> Model:
    """Choose the power of the length and fit slope and bias; rows (weight, words, label)."""
    import numpy as np

    w, n, y = (np.array(x, float) for x in zip(*rows))
    best = None
    for power in POWERS:
        x = np.log1p(w / np.maximum(n, 1) ** power)
        top = x.max() or 1.0
        a, b = 0.0, 0.0
        for _ in range(60):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * x / top + b, -30, 30)))
            g = np.array([((p - y) * x / top).sum() + 0.05 * a, (p - y).sum() + 0.05 * b])
            v = p * (1 - p)
            h = np.array([[(v * x * x).sum() / top**2 + 0.05, (v * x).sum() / top], [(v * x).sum() / top, v.sum() + 0.05]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -4, 4), b - np.clip(step[1], -4, 4)
        p = np.clip(1 / (1 + np.exp(-np.clip(a * x / top + b, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, a / top, b)
    return Model(model.terms, model.exceptions, best[1], float(best[2]), float(best[3]))


def _weights(df: DataFrame, model: Model, extra: str) -> DataFrame:
    """``extra`` (a column that is kept), weight, matches and words of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[extra].dataType.simpleString()

    def weighed(batches):
        import pyarrow as pa

        automaton, fold = shared.value.automaton(), folder()
        for b in batches:
            got = [matched(automaton, fold(t)) for t in b.column("text").to_pylist()]
            w, k, n = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("extra"), pa.array(w, pa.float64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["extra", "weight", "matches", "words"])

    return df.select(F.col(extra).alias("extra"), "text").mapInArrow(weighed, f"extra {kind}, weight double, matches long, words long")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST, exceptions: tuple[str, ...] = ()) -> Model:
    """Fit lexicon, exception phrases and curve on labelled rows of ``docs``."""
    common.small_batches(docs.sparkSession)
    sample = _sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), most)
    terms = _lexicon(sample)
    fold = folder()
    phrases = [" ".join(fold(p).split()) for p in exceptions] + _phrases(sample, terms)
    model = Model(terms, phrases)
    rows = [(r.weight, r.words, int(r.extra > 0)) for r in _weights(sample, model, "toxic").collect()]
    if not terms or not rows:
        return model
    return _curve(rows, model)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted, weight, matches, n_words`` for each row."""
    common.small_batches(docs.sparkSession)
    x = F.log1p(F.col("weight") / F.pow(F.greatest(F.col("words"), F.lit(1)), F.lit(model.power)))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.bias))))
    out = _weights(docs, model, "doc_id").select(F.col("extra").alias("doc_id"), score.alias("score"), "weight", "matches", F.col("words").alias("n_words"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "matches", "n_words")

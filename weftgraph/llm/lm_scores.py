"""Document probabilities from a subword lattice.

A document is a sequence of words and one end.  The probability of a word is
the sum over all paths through its lattice, by a forward recursion in log
space.  The arcs are all pieces of an existing vocabulary, weighted by the
vocabulary's own scores (the file's scores are merge ranks r; a weight is
1 / (100 + r), normalised), and for words of the training documents one arc
more, the whole word, with an absolutely discounted share of the word counts.
The mass that discounting frees is the weight of all piece paths:

    P(w) = max(c - D, 0) / N + D * V / N * lattice(w),

a proper distribution, since lattice(w) sums to at most 1 over words.

Beside this ``score`` come ``lattice_score``, the vocabulary's lattice alone,
and ``adapted_score``, where the piece weights are re-estimated on the
distinct training words (expectation over all segmentations).

Plan.  Words are counted with a map-side sum and one shuffle.  The most
frequent words (at most ``HEAD``, a fixed bound) go to all workers with their log
probabilities; other words of a document are shuffled by word to meet their
counts and summed back by document.  Distinct words are a table that grows
with the corpus and is never collected.

Null and empty texts are the end alone.  Ids may be null or repeat: rows are
scored each.  A word of any length is summed as a whole: beyond ``LONG`` bytes
the recursion keeps only the last few places.  Other columns of the input,
whatever their names, are not read.  Without training documents N is 0, the
lattice has all mass and ``base_score`` is 0 for want of counts; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HEAD = 200_000
DISCOUNT = 0.75
ROUNDS = 2
LONG = 1024
BATCH_BYTES = 8 << 20
END = b"\n"  # no word holds white space


class Pieces:
    """The vocabulary as a lattice over UTF-8 bytes of lower-case words.

    Every byte is a piece, so each word has a path.  Pieces are looked up by
    a rolling hash of their bytes, for many words of one length at a time.
    ``weights`` are further sets of piece weights beside the vocabulary's own;
    results have one row for each set.
    """

    def __init__(self, model_file: str, *weights):
        import numpy as np
        import sentencepiece

        self.np = np
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        rank: dict[bytes, int] = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            b = bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
            if b == b.lower() and b.strip(b" ") and b" " not in b[1:]:
                rank[b] = min(rank.get(b, 1 << 30), -int(sp.get_score(i)) if not sp.is_byte(i) else 1 << 15)
        for i in range(256):
            rank.setdefault(bytes([i]), 1 << 15)
        self.pieces = sorted(rank)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order
        self.places = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        sets = [np.array([1.0 / (100 + rank[p]) for p in self.pieces]), *weights]
        self.logp = np.log([w / w.sum() for w in sets])
        # direct-mapped table: one look-up decides most misses
        self.bits = 20
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    MULTIPLIER = 0x9E3779B97F4A7C15

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h ^ (b + 1)) * self.MULTIPLIER) & (2**64 - 1)
            h ^= h >> 29
        return h

    def _arcs(self, chars, n: int):
        """Yield (start, end, which words, piece ids) for words of n bytes, by end."""
        np = self.np
        m = np.uint64(self.MULTIPLIER)
        by_end: dict[int, list] = {j: [] for j in range(1, n + 1)}
        plus = chars.astype(np.uint64) + np.uint64(1)
        h = np.zeros((len(chars), n + 1), np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            k = n - length + 1
            h = (h[:, :k] ^ plus[:, length - 1 :]) * m
            h ^= h >> np.uint64(29)
            w, s = np.nonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            found = h[w, s]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            w, s, ids = w[hit], s[hit], self.ids[at[hit]]
            order = np.argsort(s, kind="stable")
            w, s, ids = w[order], s[order], ids[order]
            cuts = np.searchsorted(s, np.arange(k + 1))
            for i in range(k):
                if cuts[i + 1] > cuts[i]:
                    part = slice(cuts[i], cuts[i + 1])
                    by_end[i + length].append((i, w[part], ids[part]))
        return by_end

    def _groups(self, words: list[bytes]):
        """(places, byte matrix) of ' ' + word, for words of one length at a time."""
        np = self.np
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, places in by.items():
            step = max(1, 400_000 // n)
            for a in range(0, len(places), step):
                part = places[a : a + step]
                data = b"".join(b" " + words[i] for i in part)
                yield np.array(part), np.frombuffer(data, np.uint8).reshape(len(part), n), n

    def _forward(self, by_end, count: int, n: int):
        """alpha[set, place, word]: log of the sum over all paths from the start."""
        np = self.np
        alpha = np.full((len(self.logp), n + 1, count), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, n + 1):
            for i, w, ids in by_end[j]:
                alpha[:, j, w] = np.logaddexp(alpha[:, j, w], alpha[:, i, w] + self.logp[:, ids])
        return alpha

    def _arcs_at(self, word: bytes, i: int):
        """(end, piece) of the arcs that leave place i of one word."""
        found = ((j, self.places.get(word[i:j])) for j in range(i + 1, min(i + self.longest, len(word)) + 1))
        return [(j, p) for j, p in found if p is not None]

    def _long(self, word: bytes):
        """The marginals of one long word, place by place; memory does not grow with its length."""
        np = self.np
        ahead = {0: np.zeros(len(self.logp))}
        for i in range(len(word)):
            here = ahead.pop(i)
            for j, p in self._arcs_at(word, i):
                x = here + self.logp[:, p]
                ahead[j] = np.logaddexp(ahead[j], x) if j in ahead else x
        return ahead[len(word)]

    def _long_expected(self, word: bytes, total) -> None:
        """Add the expected uses in one long word, by the last set, to ``total``."""
        np, logp = self.np, self.logp[-1]
        n = len(word)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for i in range(n):
            for j, p in self._arcs_at(word, i):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[p])
        for i in range(n - 1, -1, -1):
            for j, p in self._arcs_at(word, i):
                beta[i] = np.logaddexp(beta[i], beta[j] + logp[p])
                total[p] += np.exp(alpha[i] + logp[p] + beta[j] - alpha[n])

    def log_marginals(self, words: list[bytes]):
        """Natural log of each word's probability over all segmentations, a row for each set of weights."""
        out = self.np.zeros((len(self.logp), len(words)))
        for places, chars, n in self._groups(words):
            if n > LONG:
                for k in places:
                    out[:, k] = self._long(b" " + words[k])
            else:
                out[:, places] = self._forward(self._arcs(chars, n), len(places), n)[:, n]
        return out

    def expected(self, words: list[bytes]):
        """Expected number of uses of each piece by the last set of weights, summed over ``words``."""
        np = self.np
        total = np.zeros(len(self.pieces))
        logp = self.logp[-1]
        for places, chars, n in self._groups(words):
            if n > LONG:
                for k in places:
                    self._long_expected(b" " + words[k], total)
                continue
            by_end = self._arcs(chars, n)
            alpha = self._forward(by_end, len(places), n)[-1]
            beta = np.full((n + 1, len(places)), -np.inf)
            beta[n] = 0.0
            for j in range(n, 0, -1):
                for i, w, ids in by_end[j]:
                    beta[i, w] = np.logaddexp(beta[i, w], beta[j, w] + logp[ids])
            arcs = [(j, *arc) for j in by_end for arc in by_end[j]]
            uses = [np.exp(alpha[i, w] + logp[ids] + beta[j, w] - alpha[n, w]) for j, i, w, ids in arcs]
            if arcs:
                total += np.bincount(np.concatenate([a[3] for a in arcs]), np.concatenate(uses), len(total))
        return total


def _pieces(model_file: str, *weights) -> Pieces:
    """One lattice for each worker process."""
    import zlib

    return common.held(("pieces", model_file, *(zlib.crc32(w.tobytes()) for w in weights)), lambda: Pieces(model_file, *weights))


def _coded(texts):
    """(words, codes, rows) of an Arrow array of texts: its distinct words, lower-cased, which each token is and the text it is in."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    rows = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy())
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # what stands before a first and after a last space
    if empty >= 0:
        some = codes != empty
        codes, rows = np.compress(some, codes), np.compress(some, rows)
    return words, codes, rows


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of the texts with one END for each document."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        ends = 0
        for b in common.batched(batches, BATCH_BYTES):
            words, codes, _ = _coded(b.column("text"))
            k = np.bincount(codes, minlength=len(words))
            ends += b.num_rows
            t = pa.Table.from_arrays([words.cast(pa.binary()), pa.array(k, pa.int64())], ["word", "k"])
            yield from t.filter(pa.array(k > 0)).to_batches(max_chunksize=50_000)
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "k"])

    counted_ = docs.select("text").mapInArrow(counted, "word binary, k long").groupBy("word").agg(F.sum("k").alias("c"))
    return counted_.filter("c > 0")


def _larger(batches, rows: int = 50_000):
    """The same rows in batches large enough for vector code."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Model:
    """What training leaves: the word table, its totals and the piece weights."""

    def __init__(self, words: DataFrame, n: int, v: int, ends: int, model_file: str, weights):
        self.words, self.n, self.v, self.ends, self.model_file, self.weights = words, n, v, ends, model_file, weights


def _em_round(words: DataFrame, model_file: str, weights):
    """Expected piece counts over the distinct words; one row per piece comes back."""
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def expected(batches):
        import numpy as np
        import pyarrow as pa

        pieces = _pieces(model_file, shared.value)
        total = np.zeros(len(pieces.pieces))
        for b in _larger(batches):
            total += pieces.expected(b.column("word").to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.float64())], ["piece", "k"])

    found = words.select("word").mapInArrow(expected, "piece long, k double").groupBy("piece").agg(F.sum("k").alias("k"))
    return [(r.piece, r.k) for r in found.collect()]


def learn(docs: DataFrame, model_file: str, rounds: int = ROUNDS) -> Model:
    """Count the words of ``docs`` and estimate the piece weights."""
    import numpy as np

    common.small_batches(docs.sparkSession)
    words = common.staged(word_counts(docs), "words")
    n, v, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    start = Pieces(model_file)
    weights = np.exp(start.logp[0])
    inner = words.filter(F.col("word") != F.lit(END))
    for _ in range(rounds if v else 0):
        found = _em_round(inner, model_file, weights)
        weights = np.full(len(start.pieces), 0.01)  # every piece keeps some mass
        for piece, k in found:
            weights[piece] += k
        weights /= weights.sum()
    return Model(words, n, v, ends, model_file, weights)


#: log10 of a word's probability: with the whole-word arc, by pieces alone, with re-estimated pieces.
KINDS = ("lp", "lattice", "adapted")


def _log_terms(model: Model, df: DataFrame) -> DataFrame:
    """``df`` (word, c) with KINDS of each word."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    n, v, file = model.n, model.v, model.model_file

    def terms(batches):
        import numpy as np
        import pyarrow as pa

        pieces = _pieces(file, shared.value)
        for b in _larger(batches):
            words = b.column("word").to_pylist()
            c = b.column("c").to_numpy().astype(float)
            plain, adapted = lattice = pieces.log_marginals(words)
            if n:
                with np.errstate(divide="ignore"):
                    plain, adapted = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / n), np.log(DISCOUNT * v / n) + lattice)
            found = [pa.array(x / np.log(10), pa.float64()) for x in (plain, lattice[0], adapted)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in b.schema.names), *found], [*b.schema.names, *KINDS])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(terms, schema + "".join(f", {k} double" for k in KINDS))


def _head_count(words: DataFrame, most: int = HEAD) -> float:
    """The least power of 2 ** (1/8) that at most ``most`` words reach with their counts.

    Words are counted by the logarithm of their count, a few hundred groups
    at any size, so no task ranks the words.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = words.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
    total, least = 0, float("inf")
    for b, n in sizes:
        total += n
        if total > most:
            break
        least = 2 ** (b / 8) * (1 - 1e-12)
    return least


def scores(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, adapted_score``."""
    import math
    import uuid

    spark = docs.sparkSession
    common.small_batches(spark)
    n, v = model.n, model.v
    inner = model.words.filter(F.col("word") != F.lit(END))
    head = inner.filter(F.col("c") >= _head_count(inner))
    rows = _log_terms(model, common.staged(head, "head")).collect()
    shared = spark.sparkContext.broadcast(([bytes(r.word) for r in rows], [[math.log10(r.c + 1), *(r[k] for k in KINDS)] for r in rows]))
    held_key = ("head", uuid.uuid4().hex)
    end_p = (max(model.ends - DISCOUNT, 0) / n) if n and model.ends else 1.0
    end_lp, end_c = math.log10(end_p) if end_p > 0 else math.log10(0.5 / (n + 1)), model.ends
    sums = ("base", *KINDS)

    def split(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def made():
            words, values = shared.value
            return pa.array(words, pa.binary()).cast(pa.string()), np.array(values, float).reshape(len(words), len(sums))

        words_of, values = common.held(held_key, made)
        for b in common.batched(batches, BATCH_BYTES):
            words, codes, rows = _coded(b.column("text"))
            at = pc.index_in(words, value_set=words_of).fill_null(-1).to_numpy()[codes]
            m = b.num_rows
            inside = at >= 0
            where, row = np.compress(inside, at), np.compress(inside, rows)
            out = [pa.array(np.bincount(rows, minlength=m), pa.int64()), pa.array(np.bincount(row, minlength=m), pa.int64())]
            out += [pa.array(np.bincount(row, values[where, k], m), pa.float64()) for k in range(len(sums))]
            # words beyond the head, each once a text with its number of times
            key, times = np.unique(np.compress(~inside, rows) * max(1, len(words)) + np.compress(~inside, codes), return_counts=True)
            offsets = pa.array(np.searchsorted(key // max(1, len(words)), np.arange(m + 1)), pa.int32())
            rest = words.take(pa.array(key % max(1, len(words)))).cast(pa.binary())
            out += [pa.ListArray.from_arrays(offsets, rest), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            yield from pa.Table.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("row"), *out], names).to_batches(max_chunksize=common.BATCH_ROWS)

    names = ["doc_id", "held_out", "row", "n", "known", *sums, "words", "times"]
    # Rows are told apart by a number that is fixed once staged.
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, held_out boolean, row long, n long, known long" + "".join(f", {k} double" for k in sums) + ", words array<binary>, times array<int>"
    parts = common.staged(picked.mapInArrow(split, schema), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    words = model.words.select("word", "c")
    known = _log_terms(model, rare.select("word").distinct().join(words, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c")))
    known = common.staged(known.withColumn("base", F.log10(F.col("c") + 1)), "rare")
    met = rare.join(known, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"),
        *[F.sum(F.col("k") * F.col(x)).alias(f"{x}2") for x in sums],
    )
    norm = math.log10(n + v + 1)
    joined = parts.drop("words", "times").join(met, "row", "left")
    total = {x: F.col(x) + F.coalesce(F.col(f"{x}2"), F.lit(0)) for x in ("known", *sums)}
    return joined.select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (total["known"] + (1 if end_c else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (total["base"] + math.log10(end_c + 1) - (F.col("n") + 1) * norm).alias("base_score"),
        (total["lp"] + end_lp).alias("score"),
        (total["lattice"] + end_lp).alias("lattice_score"),
        (total["adapted"] + end_lp).alias("adapted_score"),
    )

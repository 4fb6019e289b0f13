"""Benchmark decontamination by SimHash of item-sized windows.

Shingles are five lower-case words; an item of fewer words is one shingle of
all its words.  A window has as many words as an item.

Windows.  A window without any shingle of any item has similarity 0 to all, so
windows are laid only where a shingle of some item stands at its place in it.
Which item, if any, a window resembles is not known from that.

Index.  A window's fingerprint has 128 bits, each the majority over its
shingles, counted as often as they occur.  Fingerprints are cut into BLOCKS
blocks of 16 bits.  Two that differ in at most RADIUS bits differ in at most
RADIUS // BLOCKS bits in one block at least, so every item is entered under all
values within so many bits of each of its blocks, and an equi-join of windows
and items of one size on (block number, value) finds all within the radius.
At similarity 0.8 fingerprints differ in 19 bits on average, standard
deviation 4; RADIUS is 31, which misses about 2 of 1000 pairs at 0.8 and fewer
above it.  Of unrelated pairs of one size about 1 in 12 meet in a block.

Verification.  What the index finds is checked for its distance and then
exactly: the weighted Jaccard similarity (sums of least and greatest counts)
must be 0.8.  Windows with equal fingerprints are looked up once.

Everything is built-in expressions.  Item shingles are broadcast only up to
``BROADCAST_SHINGLES`` rows; beyond, they are joined by shuffle.

Null and empty texts and items match nothing.  A document of fewer words than
an item is one window.  Documents with a null id are told apart by their text;
rows with one id count as one document.  Other columns, whatever their names,
are not read; a very long text takes memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BLOCKS, BLOCK_BITS = 8, 16
RADIUS = 31
SALTS = 16
SIMILARITY = (80, 100)
BROADCAST_SHINGLES = 2_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), common.GAP), lambda w: w != "")


def _hashed(words: Column, i: Column | int, k: int) -> Column:
    """The hash of k words from place i on; places beyond the last word count nothing."""
    return F.xxhash64(*[F.get(words, F.lit(i) + j if isinstance(i, int) else i + j) for j in range(k)])


def _shingles(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of the shingles of k words in order; one for fewer words."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: _hashed(words, i, k))).otherwise(F.array().cast("array<bigint>"))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _majorities(hashes: Column, n: Column) -> Column:
    """A long whose bits are the majorities over ``hashes``, counted in two fields of 32 bits at a time."""
    low = _long((1 << 32) - 1)
    places = F.sequence(F.lit(0), F.lit(31))
    sums = F.transform(places, lambda j: F.aggregate(hashes, _long(0), lambda acc, h: acc + F.call_function("shiftright", h, j).bitwiseAND(_long((1 << 32) + 1))))

    def joined(sums):
        def step(acc, j):
            x = F.get(sums, j)
            bit = F.when(x.bitwiseAND(low) * 2 > n, F.call_function("shiftleft", _long(1), j)).otherwise(_long(0))
            high = F.when(F.call_function("shiftright", x, F.lit(32)) * 2 > n, F.call_function("shiftleft", _long(1), j + 32)).otherwise(_long(0))
            return acc.bitwiseOR(bit).bitwiseOR(high)

        return F.aggregate(places, _long(0), step)

    return F.get(F.transform(F.array(sums), joined), F.lit(0))  # one evaluation of the sums


def _with_fingerprint(df: DataFrame, shingles: str, names: tuple[str, str]) -> DataFrame:
    s = F.col(shingles)
    return df.withColumns({names[0]: _majorities(s, F.size(s)), names[1]: _majorities(F.transform(s, lambda h: F.xxhash64(h)), F.size(s))})


def _blocks(f1: str, f2: str) -> Column:
    """The BLOCKS blocks of a fingerprint, as ints."""
    half = BLOCKS // 2
    return F.array(*[F.call_function("shiftright", F.col(f), F.lit(BLOCK_BITS * k)).bitwiseAND(_long((1 << BLOCK_BITS) - 1)).cast("int") for f in (f1, f2) for k in range(half)])


def _near_values(value: Column) -> Column:
    """All values within RADIUS // BLOCKS bits of a block."""
    flips = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= RADIUS // BLOCKS]
    return F.transform(F.lit(flips).cast("array<int>"), lambda x: value.bitwiseXOR(x))


def _distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def _count(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def _shared(a: str, b: str) -> Column:
    """Sum over shingles of the lesser count."""
    x, y = F.col(a), F.col(b)
    each = F.transform(F.array_intersect(x, y), lambda h: F.least(_count(x, h), _count(y, h)))
    return F.aggregate(each, F.lit(0), lambda p, q: p + q)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    w = benchmark.select(benchmark[id_col].alias("item_id"), _words(benchmark[text_col]).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    items = w.select("item_id", F.size("w").alias("m"), _shingles(F.col("w")).alias("item_s")).distinct()
    return common.staged(_with_fingerprint(items, "item_s", ("g1", "g2")).withColumn("item", F.xxhash64("item_id", "item_s")), "items")


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)))


def _laid(base: DataFrame, items: DataFrame) -> DataFrame:
    """``key, laid``: the distinct (m, start) of the windows to look at in each document."""
    sizes = [r.m for r in items.filter(F.col("m") < SHINGLE).select("m").distinct().collect()]  # at most four
    found = None
    for k in [*sizes, SHINGLE]:
        own = items.filter(F.col("m") == k if k < SHINGLE else F.col("m") >= SHINGLE)
        grams = own.select("m", F.posexplode("item_s").alias("at", "h")).distinct()
        if common.size_at_most(grams, BROADCAST_SHINGLES):
            grams = F.broadcast(grams)
        stream = base.select("key", _words(F.col("text")).alias("w")).filter(F.size("w") >= (k if k < SHINGLE else 1))
        stream = stream.select("key", F.posexplode(_shingles(F.col("w"), k)).alias("place", "h"))
        starts = stream.join(grams, "h").select("key", "m", (F.col("place") - F.col("at")).alias("start"))
        found = starts if found is None else found.union(starts)
    starts = common.staged(found.distinct(), "starts")
    return common.staged(starts.groupBy("key").agg(F.collect_list(F.struct("m", "start")).alias("laid")), "laid")


def _windows(base: DataFrame, laid: DataFrame) -> DataFrame:
    """``key, doc_id, m, start, s, f1, f2`` of every window, staged."""
    hit = base.join(laid, "key").select("key", "doc_id", "laid", _words(F.col("text")).alias("w"))
    hit = hit.select("key", "doc_id", "laid", "w", F.size("w").alias("n"), _shingles(F.col("w")).alias("all_s"))

    def clipped(x):
        return F.struct(x.m.alias("m"), F.least(F.greatest(x.start, F.lit(0)), F.greatest(F.col("n") - x.m, F.lit(0))).alias("start"))

    rows = hit.select("key", "doc_id", "w", "all_s", F.explode(F.array_distinct(F.transform("laid", clipped))).alias("x"))
    m, start = F.col("x.m"), F.col("x.start")
    s = F.slice(F.col("all_s"), start + 1, F.greatest(m - (SHINGLE - 1), F.lit(1)))
    for k in range(1, SHINGLE):
        s = F.when(m == k, F.array(_hashed(F.col("w"), start, k))).otherwise(s)
    rows = rows.select("key", "doc_id", m.alias("m"), start.alias("start"), s.alias("s")).filter(F.size("s") > 0)
    return common.staged(_with_fingerprint(rows, "s", ("f1", "f2")), "windows")


def _within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """``m, f1, f2, item, distance``: the items within RADIUS of each distinct fingerprint, by blocks."""
    prints = windows.select("m", "f1", "f2").distinct()
    a = prints.select("m", "f1", "f2", F.posexplode(_blocks("f1", "f2")).alias("block", "value"))
    b = items.select("m", "item", "g1", "g2", F.posexplode(_blocks("g1", "g2")).alias("block", "own"))
    b = b.select("m", "item", "g1", "g2", "block", F.explode(_near_values(F.col("own"))).alias("value"))
    # The planner sees a small table behind b, not its many values: never broadcast it.
    near = a.join(b.hint("merge"), ["m", "block", "value"]).withColumn("distance", _distance(("f1", "f2"), ("g1", "g2")))
    return common.staged(near.filter(F.col("distance") <= RADIUS).select("m", "f1", "f2", "item", "distance").distinct(), "near")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``key, doc_id, item_id, start, n_words, distance, similarity``: the best window of each document and item.

    ``start`` is the place of the window's first word, from 0.
    """
    num, den = similarity
    items = _items(benchmark, item_col, item_text_col)
    base = docs.select(_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    windows = _windows(base, _laid(base, items))
    near = _within_radius(windows, items)
    # one passage may be in very many documents: salted, as all of its windows share a fingerprint
    dealt = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = windows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(dealt, ["m", "f1", "f2", "salt"])
    met = met.join(items.select("item", "item_id", "item_s"), "item")
    met = met.withColumn("shared", _shared("s", "item_s")).withColumn("all", F.size("s") + F.size("item_s") - F.col("shared"))
    met = met.filter(F.col("shared") * den >= F.col("all") * num).withColumn("similarity", F.col("shared") / F.col("all"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), F.col("m"), (-F.col("distance")).alias("distance"))).alias("b")
    out = met.groupBy("key", "item_id").agg(F.first("doc_id").alias("doc_id"), best)
    return out.select("key", "doc_id", "item_id", (-F.col("b.start")).cast("long").alias("start"), F.col("b.m").cast("long").alias("n_words"), (-F.col("b.distance")).cast("long").alias("distance"), F.col("b.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``."""
    gone = common.staged(contaminated(docs, benchmark, similarity).select(F.col("key").alias("_key")).distinct(), "leaks")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _key(docs, "doc_id", "text").alias("_key"))
    return whole.join(gone, "_key", "left_anti").select("_row.*")

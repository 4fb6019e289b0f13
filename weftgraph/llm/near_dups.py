"""Near-duplicate documents by circulant MinHash.

Signature.  A document is the set of 64-bit hashes of its word shingles.  One
permutation sends a shingle to a place on a circle of ``CIRCLE`` places, the
second, ``pi``, numbers the places.  Coordinate k of the signature is the
least number under ``pi`` shifted by k: all coordinates come from one table,
as the minimum over the windows ``pi[p], pi[p+1], ...`` of the places p.

Candidates.  32 bands of 4 coordinates; a pair of similarity 0.8 shares none
of them with probability 5e-8.  Texts with equal sets are one class before
banding, so copies never meet in pairs.  In each bucket every class is paired
with one pivot, in a second round (where several components are left in a
bucket) with the class that has most bucket mates.  Classes that are still in
buckets of several components are joined exactly by prefix filtering: with
shingles ordered by frequency, two sets of similarity 0.8 share one of the
rarest fifth of their shingles.  Only pairs of different components are made,
and the largest component of a shingle is not paired with itself, so no step
lists all pairs of a large group.

Pairs whose 128 one-bit coordinates agree in fewer than 98 are dropped (at
similarity 0.8, 115 agree on average, standard deviation 3.4).  All others are
verified on the full sets.  Links are joined to components without collecting.

Nulls and empty texts have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle.  Rows with a null id come
back unlinked (``component_id`` null, ``kept`` true).  Repeated ids are one
node: whatever one of their rows is linked with, all are; each row comes back.
An empty table gives none; other columns, whatever their names, are not read; a
very long text takes memory in proportion to its length.

Shingles are compared by 64-bit hashes, so two different ones of a pair count
as equal with odds of about n * m to 2 ** 64 for sets of n and m shingles.
Equal sets are told by a 64-bit hash too: among k different sets, two fall
together with odds of about k * k to 2 ** 65 (a billion texts: 3 in 100).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COORDINATES, BANDS, ROWS = 128, 32, 4
CIRCLE = 1 << 22
BITS_LEAST = 98


class Signer:
    """Shingle sets and circulant signatures of single texts."""

    def __init__(self, shingle: int):
        import numpy as np
        import xxhash

        self.np, self.k, self.digest = np, shingle, xxhash.xxh3_64_intdigest
        pi = np.random.RandomState(20240229).permutation(CIRCLE).astype(np.int32)
        ring = np.concatenate([pi, pi[: COORDINATES - 1]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)
        self.odd = np.random.RandomState(7).randint(1, 1 << 62, size=(2, ROWS + 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str | None):
        """Sorted distinct 64-bit hashes of the shingles."""
        np = self.np
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.digest, words), np.uint64, len(words))
        n = max(1, len(words) - self.k + 1)
        m = np.uint64(0x9E3779B97F4A7C15)
        out = np.full(n, min(self.k, len(words)), np.uint64)
        for i in range(min(self.k, len(words))):
            out = (out ^ h[i : i + n]) * m
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def sign(self, shingles):
        """(class id, band keys, two longs of one-bit coordinates)."""
        np = self.np
        node = self.digest(shingles.tobytes()) & (2**64 - 1)
        mixed = (shingles ^ (shingles >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        places = (mixed >> np.uint64(42)).astype(np.int64)
        least = None
        for i in range(0, len(places), 8192):
            part = self.windows[places[i : i + 8192]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        rows = least.reshape(BANDS, ROWS).astype(np.uint64)
        keys = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * self.odd[0, ROWS]
        for i in range(ROWS):
            keys = (keys ^ rows[:, i]) * self.odd[0, i]
            keys ^= keys >> np.uint64(31)
        bits = np.packbits(least * np.int32(-1640531527) < 0).view(np.int64)
        return node - (1 << 64) if node >= 1 << 63 else node, keys.view(np.int64), int(bits[0]), int(bits[1])


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document; node null where there are no shingles."""

    def signed(batches):
        import pyarrow as pa

        signer = _signer(shingle)
        for b in batches:
            n, rows = [], []
            for text in b.column("text").to_pylist():
                s = signer.shingles(text)
                n.append(len(s))
                rows.append(signer.sign(s) if len(s) else (None, None, None, None))
            node, bands, b1, b2 = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(b1, pa.int64()), pa.array(b2, pa.int64())],
                ["doc_id", "n_shingles", "node", "bands", "b1", "b2"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(signed, f"doc_id {kind}, n_shingles long, node long, bands array<long>, b1 long, b2 long")


def _signer(shingle: int) -> Signer:
    """One signer for each worker process."""
    return common.held(("signer", shingle), lambda: Signer(shingle))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, s``: the full sets of the given documents, one row for each set."""

    def made(batches):
        import pyarrow as pa

        signer = _signer(shingle)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                sets = [s for s in map(signer.shingles, b.column("text").slice(i, 200).to_pylist()) if len(s)]
                nodes = [x - (1 << 64) if x >= 1 << 63 else x for x in (signer.digest(s.tobytes()) for s in sets)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    return docs.mapInArrow(made, "node long, s array<long>")


def _alike(num: int, den: int):
    """Size and one-bit tests of two structs ``a`` and ``b`` (node, n, b1, b2, comp) of different components."""
    x, y = F.col("a"), F.col("b")
    same = 128 - F.bit_count(x.b1.bitwiseXOR(y.b1)) - F.bit_count(x.b2.bitwiseXOR(y.b2))
    sizes = F.least(x.n, y.n) * den >= F.greatest(x.n, y.n) * num
    return (x.comp != y.comp) & sizes & (same >= BITS_LEAST)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * |intersection| >= num * |union| on the full sets."""
    a = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared
    return both.filter(shared.cast("long") * den >= union.cast("long") * num).select("u", "v")


class _Search:
    """The steps that share the signed documents."""

    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int):
        self.docs, self.shingle, self.num, self.den = docs, shingle, num, den
        self.signed = common.staged(_signed(docs, shingle), "signed")
        named = self.signed.filter("node is not null and doc_id is not null")
        classes = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("b1").alias("b1"), F.first("b2").alias("b2"))
        self.classes = common.staged(classes, "classes")
        twins = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u <> w").select("doc_id", "u")
        self.links = named.join(twins, "doc_id").filter("node <> u").select("u", F.col("node").alias("v")).distinct()

    def attributes(self, roots: DataFrame | None) -> DataFrame:
        """``node, me``: what a class carries into the tests of a pair."""
        c = self.classes.select("node", "n", "b1", "b2")
        if roots is None:
            c = c.withColumn("comp", F.col("node"))
        else:
            c = c.join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return c.select("node", F.struct("node", "n", "b1", "b2", "comp").alias("me"))

    def plausible(self, pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Distinct (u, v) of ``pairs`` that pass the tests on attributes."""
        me = self.attributes(roots)
        pairs = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = pairs.join(me.select(F.col("node").alias("u"), F.col("me").alias("a")), "u").join(me.select(F.col("node").alias("v"), F.col("me").alias("b")), "v")
        return pairs.filter(_alike(self.num, self.den)).select("u", "v")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node, s`` of the given classes, staged."""
        ids = common.staged(self.classes.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), "asked")
        texts = self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        made = _sets(texts, self.shingle).join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"])
        return common.staged(made, "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are links, staged."""
        pairs = common.staged(pairs, "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        links = common.staged(_verified(pairs, sets, self.num, self.den), "links")
        common.dropped(self.docs.sparkSession, sets, pairs)
        return links

    def grown(self, links: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = common.staged(links.union(more), "linked")
        return links, components(links)

    def mixed(self, met: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of ``met`` in buckets of three or more classes and several components."""
        rows = met.join(self.attributes(roots).select("node", F.col("me.comp").alias("comp")), "node")
        keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        keys = common.staged(keys, "keys")
        return common.staged(rows.join(keys, "key").select("key", "node", "m"), "mixed")

    def across(self, nodes: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs (u, v) of different components among ``nodes`` by prefix filtering."""
        sets = self.sets(nodes)
        each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("x"))
        often = each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        # Staged apart, both sides of the join are plain shuffles, which adaptive execution splits where one shingle is in very many texts.
        often = common.staged(often, "often")
        shared = each.join(often, "x").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
        # the n - size(xs) shingles of no other class come first and meet nobody
        length = F.expr(f"n - ceil(n * {self.num} / {self.den}) + 1 - (n - size(xs))").cast("int")
        prefix = shared.filter(length > 0).select("node", (F.col("n") - F.size("xs")).alias("own"), F.posexplode(F.slice("xs", F.lit(1), length)).alias("at", "p"))
        rows = prefix.select("node", (F.col("own") + F.col("at")).alias("at"), F.col("p.x").alias("x")).join(self.attributes(roots), "node")
        rows = common.staged(rows.select("x", "at", "me"), "prefix")
        tops = rows.groupBy("x", F.col("me.comp").alias("comp")).agg(F.count(F.lit(1)).alias("c"))
        tops = tops.groupBy("x").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        tops = common.staged(tops.select("x", F.col("top.comp").alias("top")), "tops")
        rows = common.staged(rows.join(tops, "x"), "met")
        few = rows.filter("me.comp <> top").select("x", F.col("at").alias("i"), F.col("me").alias("a"))
        both = few.join(rows.select("x", F.col("at").alias("j"), F.col("me").alias("b")), "x")
        # from their first common shingle on, the sets must still be able to share enough
        rest = F.least(F.col("a.n") - F.col("i"), F.col("b.n") - F.col("j"))
        met = both.filter(_alike(self.num, self.den) & (rest * (self.num + self.den) >= (F.col("a.n") + F.col("b.n")) * self.num))
        return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()

    def run(self) -> DataFrame:
        """``node, root`` of the classes."""
        members = self.classes.select("node", F.explode("bands").alias("key"))
        pivots = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        pivots = common.staged(pivots, "pivots")  # apart, so that adaptive execution can split a hot bucket
        met = common.staged(members.join(pivots, "key"), "met")
        first = self.plausible(met.select(F.col("node").alias("u"), F.col("pivot").alias("v")), None)
        links, roots = self.grown(self.links, self.confirm(first))
        left = self.mixed(met.filter("m > 2").select("key", "node", "m"), roots)
        mates = left.groupBy("node").agg(F.sum("m").alias("mates"))
        hubs = left.join(mates, "node").groupBy("key").agg(F.max(F.struct("mates", "node")).alias("hub")).select("key", F.col("hub.node").alias("v"))
        hubs = common.staged(hubs, "hubs")
        second = self.plausible(left.join(hubs, "key").select(F.col("node").alias("u"), "v"), roots)
        links, roots = self.grown(links, self.confirm(second))
        nodes = self.mixed(left, roots).select("node").distinct()
        more = self.confirm(self.across(nodes, roots))
        return self.grown(links, more)[1]


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Links hold where den * |intersection| >= num * |union| with ``similarity``
    = (num, den); ``component_id`` is the least id that is reachable.
    """
    common.small_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    search = _Search(picked, shingle, *similarity)
    roots = common.staged(search.run(), "roots")
    classes = search.classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = common.staged(classes.join(least, "root").select("node", "component_id"), "named")
    out = search.signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` without those near-duplicate to a lesser id.

    Of rows with the same kept id all stay.
    """
    gone = near_duplicates(docs, shingle, similarity).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(common.staged(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)

"""Token files: one wavelet matrix per shard.

A shard holds the token ids of consecutive documents, in ascending id order,
as succinct bit planes.  Plane j holds bit ``bits-1-j`` of every id, in the
order that the planes before it leave (zeros first, stably).  With the number
of ones before each block of 512 bits, rank and select answer, from the one
compressed row of the shard:

* ``access(i)``: the id at place i,
* ``count(id, i, j)``: how often an id occurs in a range,
* ``occurrence(id, k)``: the place of its k-th occurrence,
* ``read(i, j)``: the ids of a range.

A token table is a folder of Parquet files, one row per shard:
``part, shard, first_start, n, doc_ids, ends, planes, ranks, zeros``; planes
and ranks are zstandard-compressed, ``doc_ids`` and ``ends`` give the document
borders.  The writer deals documents to ranges of ids, closes a shard at the
first document border after ``SHARD_TOKENS`` ids, and so never holds more than
one shard and one document.

Null and empty texts give the end id alone.  Rows with equal ids are ordered
by a hash of the text and kept each; rows with a null id come first.  Other
columns, whatever their names, are not read; a very long text takes memory in
proportion to its length; an empty table gives no shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 2
SHARD_TOKENS = 1 << 21
PART_BYTES = 32 << 20
PARTS_MOST = 50_000  # parts grow beyond that many, so the table of parts stays small
CHUNKS_MOST = 300_000
BATCH_BYTES = 4 << 20  # of text that is cut into chunks at once, whole documents
GROUP = 2000  # chunks that are encoded as one text
WORD_END = "</w>"
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
BLOCK = 512

SHARD_SCHEMA = "part int, shard int, n long, bits int, doc_ids binary, null_ids binary, ends binary, planes array<binary>, ranks array<binary>, zeros array<long>"


class Wavelet:
    """A wavelet matrix over non-negative integers."""

    def __init__(self, n, bits, planes, ranks, zeros):
        self.n, self.bits, self.planes, self.ranks, self.zeros = n, bits, planes, ranks, zeros

    @classmethod
    def of(cls, ids):
        import numpy as np

        ids = np.asarray(ids)
        bits = max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=False)
        planes, ranks, zeros = [], [], []
        for j in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << j)) != 0
            packed = np.packbits(bit)
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(packed).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64) if len(packed) else np.zeros(0, np.uint64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            zeros.append(len(bit) - np.count_nonzero(bit))
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])  # far faster than indexing by a mask
        return cls(len(ids), bits, planes, ranks, zeros)

    def rank1(self, j, i):
        """Ones in plane j before the places i (an array)."""
        import numpy as np

        i = np.asarray(i, np.int64)
        block = i // BLOCK
        out = self.ranks[j][block].astype(np.int64)
        byte, end = block * (BLOCK // 8), i // 8
        plane = self.planes[j]
        for _ in range(BLOCK // 8):
            more = byte < end
            if not more.any():
                break
            out += np.where(more, np.bitwise_count(plane[np.where(more, byte, 0)]), 0)
            byte = byte + 1
        left = i % 8
        tail = plane[np.minimum(end, len(plane) - 1)] >> (8 - left).astype(np.uint8) if len(plane) else np.zeros_like(i)
        return out + np.where(left > 0, np.bitwise_count(tail.astype(np.uint8)), 0)

    def access(self, i):
        return int(self.read(i, i + 1)[0])

    def read(self, i, j):
        """The ids at places i to j-1."""
        import numpy as np

        if j - i == self.n:  # undo the stable partitions from the last plane up
            out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
            for p in range(self.bits - 1, -1, -1):
                bit = np.unpackbits(self.planes[p], count=self.n).view(bool)
                before = np.empty_like(out)
                before[np.flatnonzero(~bit)] = out[: self.zeros[p]]
                before[np.flatnonzero(bit)] = out[self.zeros[p] :] | out.dtype.type(1 << (self.bits - 1 - p))
                out = before
            return out.astype(np.uint32)
        at, out = np.arange(i, j, dtype=np.int64), np.zeros(j - i, np.uint32)
        for p in range(self.bits):
            bit_at = (self.planes[p][at // 8] >> (7 - at % 8).astype(np.uint8)) & 1 != 0
            ones_at = self.rank1(p, at)
            out = (out << np.uint32(1)) | bit_at
            at = np.where(bit_at, self.zeros[p] + ones_at, at - ones_at)
        return out

    def _range(self, token, i, j):
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self.rank1(p, [i, j])
            if token >> (self.bits - 1 - p) & 1:
                i, j = self.zeros[p] + int(a), self.zeros[p] + int(b)
            else:
                i, j = i - int(a), j - int(b)
        return i, j

    def count(self, token, i=0, j=None):
        """Occurrences of ``token`` at places i to j-1."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def _select(self, p, one, k):
        """The place of the k-th one (or zero) of plane p, from 0."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = int(self.rank1(p, [mid + 1])[0])
            if (ones if one else mid + 1 - ones) >= k + 1:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def occurrence(self, token, k):
        """The place of the k-th occurrence of ``token`` from 0, or None."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return None
        at = a + k
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            at = self._select(p, bool(one), at - self.zeros[p] if one else at)
        return at

    def packed(self) -> dict:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        return {"n": self.n, "bits": self.bits, "planes": [z.compress(p.tobytes()) for p in self.planes], "ranks": [z.compress(r.tobytes()) for r in self.ranks], "zeros": self.zeros}

    @classmethod
    def unpacked(cls, row) -> Wavelet:
        import numpy as np
        import zstandard

        z = zstandard.ZstdDecompressor()
        load = lambda xs, kind: [np.frombuffer(z.decompress(x), kind) for x in xs]
        return cls(row["n"], row["bits"], load(row["planes"], np.uint8), load(row["ranks"], np.uint32), list(row["zeros"]))


class Encoder:
    """Ids of whole texts through a bounded table of white-space chunks.

    The tokenizer's normaliser turns white space to spaces and lowers case,
    and its pre-tokenizer drops spaces, so chunks between white space are
    independent and ASCII capitals do not matter.  A batch of texts is cut and
    its distinct chunks are numbered in one vector step; chunks that the table
    lacks are encoded many at a time and cut apart again by their word-end
    tokens (letters, or letters and signs after them) or by a special token
    between them; the ids of the batch are gathered by chunk number.  Texts
    that hold an added token in any case are encoded whole by the library.
    """

    def __init__(self, tokenizer_file: str):
        import json
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.np = np
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.added = [t["content"] for t in added]
        marks = [t for t in added if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark = (marks[0]["content"], marks[0]["id"]) if marks else None
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values())
        self.closing = np.zeros(top + 1, bool)
        for token, i in vocabulary.items():
            self.closing[i] = token.endswith(WORD_END)
        self.kind = np.uint16 if top < 1 << 16 else np.uint32
        self._emptied()

    def _emptied(self) -> None:
        import pyarrow as pa

        np = self.np
        self.chunks = pa.array([], pa.string())
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, kept) -> None:
        """Drop all chunks of the table but ``kept``, those that a batch has in common with batches before it."""
        import pyarrow as pa

        np = self.np
        starts, sizes = self.starts[kept], self.sizes[kept]
        stops = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.chunks = pa.concat_arrays([self.chunks.take(pa.array(kept, pa.int64()))])
        self.starts, self.sizes, self.used = stops - sizes, sizes, len(ids)
        self.ids = np.concatenate([ids, np.zeros(1 << 16, self.kind)])

    def _encoded(self, texts: list[str]):
        return [self.np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _grouped(chunks: list[str]) -> list[list[str]]:
        return [chunks[i : i + GROUP] for i in range(0, len(chunks), GROUP)]

    def _cut(self, chunks: list[str]):
        """(ids, starts, sizes): the ids of ``chunks``, in any order, and where each has its own."""
        np = self.np
        words, signed, rest = [], [], []
        for k, c in enumerate(chunks):
            if c.isalpha():
                words.append(k)
            else:
                head = c.rstrip(SIGNS)
                (signed if head.isalpha() and head != c else rest).append(k)
        order, ids, sizes = [], [], []
        # A chunk of letters has one word end at least, one with signs after them two.
        for ends, found in ((1, words), (2, signed)):
            groups = self._grouped(found)
            for g, x in zip(groups, self._encoded([" ".join([chunks[k] for k in g]) for g in groups])):
                at = np.flatnonzero(self.closing[x]) + 1
                if len(at) != ends * len(g) or at[-1] != len(x):
                    rest += g
                    continue
                order += g
                ids.append(x)
                sizes.append(np.diff(at[ends - 1 :: ends], prepend=0))
        groups = self._grouped(rest) if self.mark else [[k] for k in rest]
        between = f" {self.mark[0]} " if self.mark else ""
        for g, x in zip(groups, self._encoded([between.join([chunks[k] for k in g]) for g in groups])):
            order += g
            if self.mark:
                at = np.flatnonzero(x == self.mark[1])
                sizes.append(np.diff(np.concatenate([[-1], at, [len(x)]])) - 1)
                x = np.compress(x != self.mark[1], x)
            else:
                sizes.append(np.array([len(x)]))
            ids.append(x)
        sizes = np.concatenate(sizes)
        starts, size_of = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[order], size_of[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate(ids), starts, size_of

    def _places(self, chunks):
        """The place in the table of each of the distinct ``chunks``, an Arrow array; what it lacks is put in."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        at = pc.index_in(chunks, value_set=self.chunks).fill_null(-1).to_numpy().astype(np.int64)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            if len(self.chunks) + len(gaps) > CHUNKS_MOST:
                known = at >= 0
                kept = np.unique(at[known])
                self._keep(kept)
                at[known] = np.searchsorted(kept, at[known])
            missing = chunks.take(pa.array(gaps))
            ids, starts, sizes = self._cut(missing.to_pylist())
            at[gaps] = len(self.chunks) + np.arange(len(gaps))
            self.chunks = pa.concat_arrays([self.chunks, missing])
            self.starts = np.concatenate([self.starts, starts + self.used])
            self.sizes = np.concatenate([self.sizes, sizes])
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return at

    def encode_all(self, texts):
        """(ids, ends): the ids of all texts, strings or an Arrow array of them, and where each text's end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), pa.scalar(None, pa.string()), texts) if whole.any() else texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = lists.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        each = coded.indices.to_numpy()
        sizes, starts = self.sizes[places][each], self.starts[places][each]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(starts - (stops - sizes), sizes)
        at += np.arange(total)
        ids = self.ids[at]
        ends = np.concatenate([[0], stops])[np.cumsum(lists.value_lengths().fill_null(0).to_numpy())] if len(texts) else np.zeros(0, np.int64)
        if whole.any():
            cut = np.split(ids, ends[:-1])
            for i, x in zip(np.flatnonzero(whole), self._encoded([texts[int(i)].as_py() for i in np.flatnonzero(whole)])):
                cut[i] = x
            ids, ends = np.concatenate(cut), np.cumsum([len(x) for x in cut])
        return ids, ends

    def encode(self, text: str | None):
        return self.encode_all([text])[0]


def _encoder(tokenizer_file: str) -> Encoder:
    """One encoder for each worker process."""
    return common.held(("encoder", tokenizer_file), lambda: Encoder(tokenizer_file))


def _parts(docs: DataFrame) -> int:
    """Ranges of ids for about PART_BYTES of text each, PARTS_MOST of them at most."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(1, -(-total // PART_BYTES)), PARTS_MOST)


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the token table to ``path``."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(_parts(docs), *keys).withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*keys, "text")

    def written(batches):
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(tokenizer_file)
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("ends", pa.binary()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64()))])
        now, shard, ids, ends, chunks, n = None, 0, [], [], [], 0

        def closed():
            w = Wavelet.of(np.concatenate(chunks)).packed()
            null = np.asarray([x is None for x in ids], bool)
            row = w | {"part": now, "shard": shard, "doc_ids": np.asarray([x or 0 for x in ids], "<i8").tobytes(), "null_ids": np.packbits(null).tobytes(), "ends": np.asarray(ends, "<i8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in common.batched(batches, BATCH_BYTES):
            found, stops = encoder.encode_all(b.column("text"))
            found = np.insert(found.astype(np.uint32, copy=False) if end_id > np.iinfo(found.dtype).max else found, stops, end_id)
            stops = stops + np.arange(1, len(stops) + 1)
            at = 0
            for p, i, stop in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), stops.tolist()):
                if ids and (p != now or n >= SHARD_TOKENS):
                    yield closed()
                    shard, ids, ends, chunks, n = (shard + 1 if p == now else 0), [], [], [], 0
                elif p != now:
                    shard = 0
                now = p
                n += stop - at
                ids.append(i)
                ends.append(n)
                chunks.append(found[at:stop])
                at = stop
        if ids:
            yield closed()

    dealt.select("part", "doc_id", "text").mapInArrow(written, SHARD_SCHEMA).write.mode("errorifexists").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The token table with ``first_start``, the ids in all shards before each.

    The totals of the parts (a bounded number) are summed on one task, those
    of the shards within their part.
    """
    from pyspark.sql import Window

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "shard", inside.alias("inside")).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("first_start"))
    return shards.join(starts, ["part", "shard"])


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) from a token table."""

    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(ids)).astype(bool)
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                tokens = Wavelet.unpacked(row).read(0, row["n"]).astype("<u4")
                crc = [zlib.crc32(tokens[i:j].tobytes()) for i, j in zip(starts, ends)]
                out = [pa.array(ids, pa.int64(), mask=null), pa.array(starts + row["first_start"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([tokens[i:j].astype(np.int64) for i, j in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return read_shards(spark, path).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _asked(spark: SparkSession, path: str, answer, schema: str) -> DataFrame:
    """Rows that ``answer(row, wavelet, first_start)`` gives for every shard of a token table."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = answer(row, Wavelet.unpacked(row), row["first_start"])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return read_shards(spark, path).mapInArrow(read, schema)


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of the distinct ``tokens`` occurs in a token table, by rank alone."""
    tokens = sorted(set(tokens))
    each = _asked(spark, path, lambda row, w, first: (tokens, [w.count(t) for t in tokens]), "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``place``: the places of ``token`` among all ids of a token table, by select alone."""

    def answer(row, w, first):
        return ([first + w.occurrence(token, k) for k in range(w.count(token))],)

    return _asked(spark, path, answer, "place long")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """``place, token`` for those of ``places`` that a token table has."""

    def answer(row, w, first):
        here = [p for p in places if first <= p < first + row["n"]]
        return here, [w.access(p - first) for p in here]

    return _asked(spark, path, answer, "place long, token long")


def token_files(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a token table and return what reading it back gives."""
    path = path or common.shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_file, path)
    return read_documents(docs.sparkSession, path)

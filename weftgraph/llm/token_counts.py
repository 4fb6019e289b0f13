"""Token counts by a map-side two-tier lookup.

A text's length in tokens is the sum of the lengths of its pre-tokens, so no
text has to be encoded as a whole and no pre-token is shuffled:

* tier 1 is a compact table of frequent pre-tokens with their lengths, made
  once on the driver and broadcast: the words that the vocabulary itself holds
  as pieces, which are those that its training found most frequent (so the
  table's size is bounded by the vocabulary, and no pass over the texts is
  needed to find them);
* tier 2 is a bounded cache in each Python worker; what it misses is encoded
  by the library.

Pre-tokens of the sentencepiece model: no piece holds a space after another
character, so merges never cross from a character to a following space.
Nor does any piece hold a line feed, which is always coded as one byte.

Null and empty texts have 0 tokens.  Repeated rows come back as often as they
went in; a null ``doc_id`` is kept as null.  Other columns are ignored.  A very
long text is counted as a whole; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import common

CACHE_ENTRIES = 300_000
_CHUNKS = re.compile(r" *[^ ]+| +")


def vocabulary_lengths(model_file: str) -> dict[str, int]:
    """Lengths of the pre-tokens that are themselves vocabulary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == "▁" and "▁" not in p[1:]]
    return {w: len(ids) for w, ids in zip(words, sp.encode(words, num_threads=1))}


class Counter:
    """Counts the tokens of whole texts through the two tiers."""

    def __init__(self, model_file: str, frequent: dict[str, int]):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        self.cache = common.Generations(self._miss, CACHE_ENTRIES)
        self.cache.old = frequent
        self.frequent = frequent

    def _miss(self, pretoken: str) -> int:
        n = self.frequent.get(pretoken)
        return len(self.sp.encode(pretoken, num_threads=1)) if n is None else n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "▁" in text or "\x00" in text:
            return len(self.sp.encode(text, num_threads=1))
        marked = text.replace("\n", " \n")
        if "  " not in marked and marked[0] != " " and marked[-1] != " ":
            n = sum(map(self.cache.__getitem__, marked.split(" "))) - text.count("\n")
        else:
            first, *rest = _CHUNKS.findall(text)
            n = len(self.sp.encode(first, num_threads=1))
            for chunk in rest:
                n += self.cache[chunk[1:]] if len(chunk) > 1 else 1
        self.cache.trim()
        return n


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``over_limit`` says that a text has more than ``limit`` tokens.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    frequent = spark.sparkContext.broadcast(vocabulary_lengths(model_file))
    key = ("counter", model_file, spark.sparkContext.applicationId)

    def counted(batches):
        import pyarrow as pa

        counter = common.held(key, lambda: Counter(model_file, frequent.value))
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One class of characters separates words everywhere in this subpackage:
#: space and U+0009 to U+000D.  ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows per Arrow batch.  A batch of whole documents must fit in a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, by rows; lasts for the session.

    Spark reads the bound when a query starts, after these operators return,
    so it cannot be put back here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset a
    temporary folder is taken and remembered in a local session, which is one
    process; a cluster is asked to name a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            return checkpoint.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def size_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def batched(batches, most: int):
    """The same rows in batches of about ``most`` bytes of text, but one text at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for b in batches:
        sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy()
        part = (np.cumsum(sizes, dtype=np.int64) + size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for i, j in zip(cuts, cuts[1:]):
            held.append(b.slice(i, j - i))
            size += int(sizes[i:j].sum())
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Generations(dict):
    """A dict that fills itself through ``make`` and stays bounded.

    Entries live in a young and an old generation of ``limit`` entries each;
    what is still used moves to the young one, the rest is dropped.  Results
    never depend on what is cached.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


_HELD: dict = {}


def held(key: tuple, make):
    """The one large object that a worker process keeps between tasks.

    Another key replaces it, so a worker that serves several stages holds the
    tables and caches of one.
    """
    if key not in _HELD:
        import ctypes
        import gc

        import pyarrow as pa

        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # give the memory back
        except (OSError, AttributeError):
            pass
        _HELD[key] = make()
    return _HELD[key]


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

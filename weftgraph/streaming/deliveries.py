"""Exactly-once deliveries: batches of statements keyed by (source, txid).

A receipt is kept for every delivery.  A repeated delivery with the same
payload gives its first result again and changes nothing; with another
payload it is a conflict.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..plans.errors import QueryError
from ..sources.staging import shared_dir

RECEIPT = "source_id string, txid string, payload string, result string"


class Deliveries:
    def __init__(self, engine: Engine):
        self.engine = engine
        if engine.receipts is None:
            engine.receipts = f"{shared_dir(engine.spark).rstrip('/')}/receipts-{uuid.uuid4().hex}"

    @property
    def receipts(self) -> DataFrame:
        """All receipts: a folder of Parquet files by source, which deliveries append to."""
        spark, path = self.engine.spark, self.engine.receipts
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], RECEIPT)
        return spark.read.schema(RECEIPT).parquet(path)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("source_id").parquet(self.engine.receipts)

    def _found(self, source_id: str, txid: str):
        rows = self.receipts.filter((F.col("source_id") == source_id) & (F.col("txid") == txid)).limit(1).collect()
        return rows[0] if rows else None

    def deliver(self, source_id: str, txid: str, statements: list[str]):
        """Apply a delivery once; its result, now or from its receipt."""
        payload = hashlib.sha256(json.dumps(statements).encode()).hexdigest()
        old = self._found(source_id, txid)
        if old is not None:
            if old.payload != payload:
                raise QueryError(f"delivery {source_id}/{txid} came before with another payload")
            return json.loads(old.result)
        out = self.engine.transaction(statements)
        row = self.engine.spark.createDataFrame([(source_id, txid, payload, json.dumps(out))], RECEIPT)
        self._append(row)
        return out

    def batch(self, rows: list[tuple[str, str, list[str]]]) -> list:
        """Deliveries in turn; the first that fails ends the batch, those before it stay."""
        return [self.deliver(*r) for r in rows]

    def forget_before(self, source_id: str, txid: str) -> None:
        """Drop a source's receipts below ``txid``."""
        kept = self.receipts.filter((F.col("source_id") != source_id) | (F.col("txid") >= txid))
        old, self.engine.receipts = kept, f"{shared_dir(self.engine.spark).rstrip('/')}/receipts-{uuid.uuid4().hex}"
        self._append(old)

    def stream(self, source: DataFrame, checkpoint: str, trigger: str | None = None):
        """Run a stream of ``source_id, txid, statement, seq`` through micro-batches.

        Receipts make a replayed micro-batch harmless.
        """

        def apply(df: DataFrame, _: int) -> None:
            grouped = df.groupBy("source_id", "txid").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "statement"))), lambda x: x.statement).alias("statements"))
            for r in grouped.orderBy("first").toLocalIterator():
                self.deliver(r.source_id, r.txid, list(r.statements))

        writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

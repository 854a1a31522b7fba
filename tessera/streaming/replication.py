"""Replication of a change log: only whole, committed transactions are applied, in commit order.

The log is a folder of files with the columns txn, seq, op ('put', 'delete', 'commit', 'rollback'),
key and value. A micro-batch may end inside a transaction: its changes wait in ``pending`` until
the commit arrives. Each batch writes new folders named by its number and then one state file, so a
batch that is run again after a failure overwrites its own output and nothing is applied twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..sources.storage import Files

SCHEMA = "txn bigint, seq bigint, op string, key string, value string"


class Replica:
    """A key-value table kept up to date from a change log."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def _last(self, before: int | None = None) -> int | None:
        done = [int(n.split(".")[0]) for n in self.files.names("state") if n.endswith(".json")]
        return max((n for n in done if before is None or n < before), default=None)

    def _read(self, kind: str, batch: int | None, schema: str) -> DataFrame:
        if batch is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{batch}")

    def rows(self) -> DataFrame:
        """The replica's (key, value) rows."""
        return self._read("table", self._last(), "key string, value string")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Apply one micro-batch; running it again gives the same state."""
        last = self._last(batch)
        waiting = self._read("pending", last, SCHEMA)
        log = changes.select("txn", "seq", "op", "key", "value").union(waiting)
        ends = log.where("op IN ('commit', 'rollback')").groupBy("txn").agg(F.max(F.struct("seq", "op")).alias("last")).select("txn", F.col("last.seq").alias("end_seq"), F.col("last.op").alias("end_op"))
        data = log.where("op IN ('put', 'delete')")
        done = data.join(ends.where("end_op = 'commit'"), "txn")
        latest = Window.partitionBy("key").orderBy(F.desc("end_seq"), F.desc("seq"))
        newest = done.withColumn("n", F.row_number().over(latest)).where("n = 1")
        table = self._read("table", last, "key string, value string")
        kept = table.join(newest.select("key"), "key", "left_anti").select("key", "value")
        kept.union(newest.where("op = 'put'").select("key", "value")).write.mode("overwrite").parquet(f"{self.folder}/table/{batch}")
        data.join(ends, "txn", "left_anti").select("txn", "seq", "op", "key", "value").write.mode("overwrite").parquet(f"{self.folder}/pending/{batch}")
        if f"{batch}.json" not in self.files.names("state"):
            self.files.create(f"state/{batch}.json", json.dumps({"batch": batch}))

    def follow(self, log_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Start following a log folder; ``once`` stops when what is there has been applied."""
        stream = self.spark.readStream.schema(SCHEMA).json(log_folder)
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

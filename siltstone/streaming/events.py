"""Structured Streaming: micro-batch ingestion with replay-safe appends, dedup and windows.

``available_now`` runs a stream over files to its end, so a batch and a stream
of the same files give the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from siltstone.operators.shared import shared_dir
from siltstone.operators.store import table_or_none


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, glob: str | None = None) -> DataFrame:
    """A stream of Parquet files below ``path``, a bounded number of them in each micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def event_time(rows: DataFrame, column: str, delay: str = "10 minutes") -> DataFrame:
    """Casts a zone-free timestamp and sets its watermark."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def dedup_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key while its watermark lasts."""
    return rows.dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, column: str, width: str, keys: list[str], value: str) -> DataFrame:
    out = rows.groupBy(F.window(column, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, column: str, gap: str, keys: list[str]) -> DataFrame:
    out = rows.groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def available_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its output as a table (every row of append mode, the last state of complete)."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    else:
        last = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/rows")
        query = stream.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def ingest(stream: DataFrame, key: str, table: str, embed: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None) -> None:
    """Append each micro-batch's new keys to ``table``; a replayed batch or a repeated item adds nothing.

    New rows are found by an anti-join with what the table holds (content addressing), and ``embed`` sees only those.
    Nothing is ever replaced, so further calls, with a checkpoint of their own or without, add to the table.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        held = table_or_none(spark, table)
        if held is not None:
            fresh = fresh.join(held.select(key), key, "left_anti")
        (embed(fresh) if embed else fresh).write.mode("append").parquet(table)

    where = checkpoint or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(step).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


class Heartbeat(StreamingQueryListener):
    """Tells ``say`` how far streams are; a message that equals the one before is left out."""

    def __init__(self, say: Callable[[str], None]):
        self.say, self.last = say, None

    def _tell(self, message: str) -> None:
        if message != self.last:
            self.last = message
            self.say(message)

    def onQueryStarted(self, event) -> None:
        self._tell(f"stream {event.name or event.id} started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell(f"stream {p.name or p.id}: {p.numInputRows} rows in batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        self._tell(f"stream {event.id} is idle")

    def onQueryTerminated(self, event) -> None:
        self._tell(f"stream {event.id} ended" + (f": {event.exception}" if event.exception else ""))


def cancel(spark: SparkSession, group: str | None = None) -> int:
    """Stop the session's running streams, and the jobs tagged ``group``; returns the number of streams stopped."""
    active = spark.streams.active
    for query in active:
        query.stop()
    if group:
        spark.interruptTag(group)
    return len(active)

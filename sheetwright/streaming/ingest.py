"""Structured Streaming: arriving documents into the store, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert


def pdf_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New PDF files of a folder as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    d = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("pdf_filename"), F.substring(F.sha2("content", 256), 1, 16).alias("pdf_hash"), "content")


def upsert_stream(rows: DataFrame, store: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Merges each micro-batch into a Parquet store of numbered snapshots.

    A batch writes snapshot ``v=<batch + 1>`` from the one before, so a batch
    that is run again after a failure writes the same snapshot again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch
        if epoch:
            old = spark.read.parquet(f"{store}/v={epoch}")
            new = upsert(old, batch, order)
        elif order:
            new = upsert(batch.drop(order).limit(0), batch, order)
        new.write.mode("overwrite").parquet(f"{store}/v={epoch + 1}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of events (ts, key) in tumbling windows, late ones dropped after ``late``."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "key").agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("start"), "key", "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there into a table in memory; for small inputs and tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def with_provider(pages: DataFrame, provider: Callable[[list[bytes]], list[str | None]], key: str = "image_hash", image: str = "image") -> DataFrame:
    """(key, reply) of a model over distinct images: each image is asked once, however many pages share it."""
    import pyarrow as pa

    def ask(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(provider(b.column(1).to_pylist()), pa.string())], names=[key, "reply"])

    once = pages.groupBy(key).agg(F.first(image).alias(image))
    return once.select(key, image).mapInArrow(ask, f"{key} string, reply string")


def logged_stream(rows: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Keeps a log of what came in: one file a micro-batch with its counts by PDF, written again if the batch is."""

    def note(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("pdf_filename").agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        counts.withColumn("batch", F.lit(epoch)).coalesce(1).write.mode("overwrite").json(f"{log}/batch={epoch}")

    return rows.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

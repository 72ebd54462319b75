"""Structured Streaming forms of the append and windowing operators.

Late filings are restatements, never dropped: watermarks bound state only where
a window's rows are final, and the append log keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oreline.operators.append import bitemporal_append


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], *, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return df.withWatermark(at, late).groupBy(window, *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def deduplicated(df: DataFrame, fingerprint: str, at: str, *, late: str = "1 day") -> DataFrame:
    """First sight of each fingerprint within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([fingerprint])


def completeness(df: DataFrame, month: str, months: int = 6) -> DataFrame:
    """Flag the months that may still fill up; they are emitted all the same."""
    newest = df.agg(F.max(month).alias("__newest"))
    marked = df.crossJoin(F.broadcast(newest))  # one row
    return marked.withColumn("incomplete_window", F.col(month) > F.add_months("__newest", -months)).drop("__newest")


def append_changes(stream: DataFrame, store_path: str, keys: list[str], vintage: str, value: str, checkpoint: str) -> StreamingQuery:
    """Change-only bitemporal append of a stream of filings to a Parquet store.

    Each micro-batch is compared with itself and with the heads on record: two
    values of one key and vintage stop the stream, equal filings count once. A
    batch that runs again after a failure appends nothing new, as its rows are
    then known.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        store = spark.read.schema(batch.schema).parquet(store_path)
        added = bitemporal_append(store, batch, keys, vintage, value)
        added.write.mode("append").parquet(store_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Drive a bounded stream to completion into an in-memory table (tests, small reports)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query

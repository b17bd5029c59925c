"""Cleaning, chunking and scoring of streams: the row-local operators need no state, counts take a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larder.functions.text import clean, has_content
from larder.operators import chunking, evaluation


def cleaned(stream: DataFrame) -> DataFrame:
    """Documents with enough letters, cleaned, as they arrive."""
    return stream.where(has_content("text")).withColumn("text", clean("text"))


def chunked(stream: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    return chunking.chunk_documents(cleaned(stream), size, overlap)


def scored(stream: DataFrame) -> DataFrame:
    return evaluation.evaluated(stream)


def counts(stream: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each key in tumbling windows of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: re-delivered rows are dropped as they arrive."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def into_table(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append every micro-batch to a Parquet table, each batch once: a batch writes to a folder of its own number, so a
    repeated batch replaces itself. All data at hand is read, then the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

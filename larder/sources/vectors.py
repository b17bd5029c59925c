"""A vector table that is rebuilt when its chunks change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(chunks: DataFrame) -> str:
    """A key of the set of ``chunk_id, text``, whatever its order: the name of its index."""
    parts = chunks.select(F.xxhash64("chunk_id", "text").alias("h"))
    row = parts.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{(row['x'] or 0) & (1 << 64) - 1:016x}-{int(row['s'] or 0) & (1 << 64) - 1:016x}"


#: Retrievers of a session, by the folder of their index.
_OPEN: dict[tuple[str, str], DataFrame] = {}


def retriever(spark: SparkSession, chunks: DataFrame, folder: str, embed: Callable, again: bool = False) -> DataFrame:
    """The index of a folder, opened once a session: later calls neither hash the chunks nor look for a new version of them,
    which only ``again`` does."""
    key = (spark.sparkContext.applicationId, folder)
    if again or key not in _OPEN:
        _OPEN[key] = load_or_build(spark, chunks, folder, embed)
    return _OPEN[key]


def load_or_build(spark: SparkSession, chunks: DataFrame, folder: str, embed: Callable) -> DataFrame:
    """``id, vector`` of ``chunks(chunk_id, text)``, from the folder if it holds an index of just these chunks, else built,
    stored as Parquet under their key, and read back. ``embed`` maps a text column to a vector column."""
    path = f"{folder}/vectors-{content_key(chunks)}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        chunks.select(F.col("chunk_id").alias("id"), embed("text").alias("vector")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

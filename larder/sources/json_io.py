"""Chunks, results and evaluated results as JSON and Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

METADATA = "struct<folder:string,doc_type:string,source:string>"
CHUNK = f"text string, metadata {METADATA}"
RESULT = "query_id bigint, query string, answer string, contexts array<string>"
EVALUATED = RESULT + ", custom_scores struct<numerical_correctness:double,unsupported_precision:double>"


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel; overwrites; null fields are kept, other scripts stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; such a file cannot be split, so lines are preferred for anything large."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def export_array(df: DataFrame, path: str) -> int:
    """Write one indented JSON array to a local file, row by row; returns the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for row in df.toLocalIterator():
            out.write(("," if n else "") + "\n" + json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str))
            n += 1
        out.write("\n]\n")
    return n


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, which is deleted when the driver ends: results that are still lazy
    may read it until then."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """What is stored of a chunk."""
    return chunks.select("text", F.struct("metadata.folder", "metadata.doc_type", "metadata.source").alias("metadata"))

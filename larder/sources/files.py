"""Scanning folders of documents, one document type each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The document types with their file name endings; endings are case-sensitive.
DOC_TYPES = {"PDF": ".pdf", "HTML": ".html", "PDF_table": ".pdf"}


def metadata_of(path: Column | str, doc_type: Column | str, root: str = "") -> Column:
    """``struct<folder, doc_type, source>``: the folder relative to ``root`` with forward slashes, and the file name.

    A path outside the root gives a null folder.
    """
    path, doc_type = (F.col(c) if isinstance(c, str) else c for c in (path, doc_type))
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/" if root else ""
    inside = F.substring(plain, len(root) + 1, 1_000_000)
    folder = F.when(plain.startswith(root), F.regexp_replace(inside, "/?[^/]*$", ""))
    return F.struct(folder.alias("folder"), doc_type.alias("doc_type"), F.regexp_extract(plain, "([^/]*)$", 1).alias("source"))


def scan_folders(spark: SparkSession, root: str, doc_types: dict[str, str] = DOC_TYPES) -> DataFrame:
    """``path, modificationTime, length, content, doc_type`` of the files with the right ending in each type's folder.

    Other files are skipped before they are read; a missing folder is an error.
    """
    scans = [spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(f"{root}/{name}").withColumn("doc_type", F.lit(name)) for name, ending in doc_types.items()]
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out


def of_types(files: DataFrame, doc_types: dict[str, str] = DOC_TYPES) -> DataFrame:
    """The rows of a file listing whose path has the ending of their type: one branch a type, as their readers differ."""
    branches = [files.where((F.col("doc_type") == name) & F.endswith("path", F.lit(ending))) for name, ending in doc_types.items()]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page_no, text, error``: pages of binary documents by any reader of bytes; a bad file is one row with its error.

    The reader is passed in: ``larder.sources.pdf`` has one for plain PDFs, and any other will do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i, text, None) for i, text in enumerate(reader(bytes(content)))]
                except Exception as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")

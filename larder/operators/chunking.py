"""Cutting documents into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a chunk and of what consecutive chunks share.
SIZE, OVERLAP = 500, 100

_TOKEN = re.compile(r"\w+|[^\w\s]")
_LEVELS = (re.compile(r"\n\s*\n+"), re.compile(r"(?<=[.!?。])\s+"), re.compile(r"(?<=[,;:])\s+"), re.compile(r"\s+"))


def count_tokens(text: str) -> int:
    """Words and punctuation marks: the default token counter, which needs no vocabulary."""
    return sum(1 for _ in _TOKEN.finditer(text))


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of at most ``size`` tokens that end with sentences where they can; each repeats at most ``overlap`` tokens of
    the one before. Blank and null texts give none."""
    if not text or not text.strip():
        return []
    parts = _parts(text, size, count, 0)
    chunks: list[list[tuple[str, int]]] = [[]]
    total, fresh = 0, False
    for part, n in parts:
        if total + n > size and fresh:
            tail: list[tuple[str, int]] = []
            kept = 0
            for old in reversed(chunks[-1]):
                if kept + old[1] > overlap or kept + old[1] + n > size:
                    break
                tail.insert(0, old)
                kept += old[1]
            chunks.append(tail)
            total = kept
        chunks[-1].append((part, n))
        total, fresh = total + n, True
    return [c for c in ("".join(p for p, _ in chunk).strip() for chunk in chunks) if c]


def _parts(text: str, size: int, count: Callable[[str], int], level: int) -> list[tuple[str, int]]:
    n = count(text)
    if n <= size and level >= 2:
        return [(text, n)]
    if level == len(_LEVELS):
        half = len(text) // 2
        return _parts(text[:half], size, count, level) + _parts(text[half:], size, count, level)
    out: list[tuple[str, int]] = []
    at = 0
    for cut in _LEVELS[level].finditer(text):
        out += _parts(text[at : cut.end()], size, count, level + 1)
        at = cut.end()
    return out + (_parts(text[at:], size, count, level + 1) if at < len(text) else [])


def rendered(metadata: str, documents: DataFrame) -> Column:
    """A struct of metadata as the lines ``name: value`` under which a chunk is embedded; null fields are left out."""
    fields = documents.schema[metadata].dataType.fieldNames()
    return F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.col(f"{metadata}.{f}").cast("string")) for f in fields])


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, metadata: str | None = None) -> DataFrame:
    """``doc_id, chunk_no, text`` and the other columns of each document: a narrow flat map in Arrow batches.

    With ``metadata``, the name of a struct column, the tokens of the rendered metadata are taken off the size, so that a
    chunk keeps it together with its metadata; a chunk may hold one token more than the overlap at least.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series, beside: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        room = [max(size - known.setdefault(m, count_tokens(m)), overlap + 1) for m in beside]
        return pd.Series([split_text(t, r, min(overlap, r - 1)) for t, r in zip(texts, room)], dtype=object)

    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    beside = rendered(metadata, documents) if metadata else F.lit("")
    return documents.select("doc_id", *rest, F.posexplode(cut("text", beside)).alias("chunk_no", "text"))


def chunk_words(documents: DataFrame, size: int = SIZE, stride: int = SIZE - OVERLAP) -> DataFrame:
    """``doc_id, chunk_no, text``: windows of ``size`` blank-separated words every ``stride`` words, all inside the JVM."""
    words = documents.select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / stride), F.lit(0)).cast("int")
    windows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return windows.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * stride + 1, size), " ").alias("text"))

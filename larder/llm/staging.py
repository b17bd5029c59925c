"""Stages written to the shared folder, and a filter of fixed size for ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.json_io import scratch_path

#: Bits of the id filter; its size does not depend on the data.
FILTER_BITS = 1 << 23
_CHUNK = 32768


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it again: it survives lost executors. The folder
    is deleted when the driver ends."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_hold(ids: DataFrame, column: str, bits: int = FILTER_BITS):
    """A function from a column to a boolean column that is true for every value of ``ids`` and false for most others.

    The bitmap has ``bits`` bits whatever the data; with very many ids it lets more rows pass, never fewer.
    """
    place = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("p"))
    parts = place.groupBy((F.col("p") / _CHUNK).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("p") % _CHUNK).alias("b")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for part, b in parts:
        bitmap[part * _CHUNK // 8 : part * _CHUNK // 8 + len(b)] = np.frombuffer(bytes(b), np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf(T.BooleanType())
    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: held(F.pmod(F.xxhash64(c), F.lit(bits)))


#: By how much the share of a sample is widened before the rows of the smallest hashes are taken from it.
SLACK = 1.25


def hash_sample(df: DataFrame, keys: list[str], rows: int, most: int) -> list:
    """At most ``most`` rows of ``df``, which has about ``rows``: those of the smallest hashes of their keys. The same rows
    in every run and however the data is partitioned (but for equal keys), and no more of them ever reach the driver."""
    share = min(1.0, SLACK * most / max(rows, 1))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    return df.where(hashed < int(share * (1 << 30)) + 1).orderBy(hashed, *keys).limit(most).collect()

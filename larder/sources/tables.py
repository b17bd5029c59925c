"""Reading the engine's tables and the contracts that hold for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a table may have at most to be sent to every task; larger ones take the join path.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; projections and filters of the caller reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> list | None:
    """The rows of ``df`` if it has at most ``most`` with at most ``most_bytes`` of text, else None: the check before anything
    is broadcast. Nothing is collected before both are known."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0))).alias("bytes")).first()
    return df.collect() if size["n"] <= most and (size["bytes"] or 0) <= most_bytes else None


def delivered(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """``key`` and the given columns of a table, each key once; only these columns and the time of loading are read."""
    return first_delivery(table(spark, sf_dir, name).select(key, "loaded_at", *columns), key).drop("loaded_at")


def first_delivery(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the one delivered first.

    Rows delivered again repeat the earlier one in everything but ``order``. Null keys are kept as one group;
    a null ``order`` counts as last, ties give the smaller row by its other columns that can be ordered.
    """
    rest = [c for c in df.columns if c != key]
    orderable = [c for c in rest if c != order and "map<" not in dict(df.dtypes)[c]]
    rank = F.struct(F.col(order).isNull(), F.col(order), *[F.col(c) for c in orderable])
    packed = df.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return packed.select(*[key if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores, where it has fewer: a small file of one row group would else
    keep costly operators in one task. Tables of as many splits as there are cores, which all large ones have, stay as they are, and
    so does what is shuffled anyway: nothing is run to find out."""
    cores, query = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if query.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(cores) if query.toRdd().getNumPartitions() < cores else df


def code_points(column: Column | str) -> Column:
    """Length in code points, null as 0."""
    return F.coalesce(F.length(column), F.lit(0))

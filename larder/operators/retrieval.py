"""Embeddings, exact nearest neighbours, contexts and prompts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import cut_lineage

#: Fixed value: contexts of a query.
TOP_K = 3
#: Bytes of query vectors that go to every task at once; more queries are asked in further passes over the corpus.
QUERY_BYTES = 32 << 20


def hash_embedding(text: Column | str, width: int = 64) -> Column:
    """A deterministic embedding: signed counts of hashed words, scaled to length 1.

    Words and hashes are made in the JVM, the vectors of a whole Arrow batch at once. Null and wordless texts give a zero
    vector.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(hashes: pa.Array) -> pa.Array:
        n = len(hashes)
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), np.diff(hashes.offsets.to_numpy()))
        counts = np.bincount(owner * width + flat % width, weights=np.where(flat >> 40 & 1, 1.0, -1.0), minlength=n * width).reshape(n, width).astype(float)
        length = np.linalg.norm(counts, axis=1, keepdims=True)
        made = np.divide(counts, length, out=np.zeros(counts.shape), where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(made.reshape(-1)))

    return vectors(F.transform(words, lambda w: F.xxhash64(w)))


def nearest(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, metric: str = "l2", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` nearest vectors of ``corpus(id, vector)`` to each of
    ``queries(query_id, vector)``, exactly.

    The stated queries are asked against all rows in blocks: a bounded block of query vectors goes to every task, each
    task multiplies it with its Arrow batches and keeps ``k`` rows a query, and only these are shuffled. Larger query sets
    take several passes. Ties go to the smaller id; null vectors and vectors of another width match nothing; fewer than
    ``k`` vectors give fewer rows. A query's own id is not left out.
    """
    spark = corpus.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    facts = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance double")
    block = max(1, query_bytes // (8 * max(facts["width"], 1)))
    passes = -(-facts["n"] // block)
    found = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        local = part.toPandas()
        if not len(local):
            continue
        ids, matrix = local["query_id"].to_numpy(np.int64), np.array(local["vector"].tolist(), np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))
        near = corpus.select("id", "vector").mapInArrow(_local_top(shared, k, metric), "query_id bigint, id bigint, distance double")
        found = near if found is None else found.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _local_top(shared, k: int, metric: str):
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best_d = np.full((len(query_ids), k), np.inf)
        best_id = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, good = _matrix(batch.column(1), queries.shape[1])
            if not len(rows):
                continue
            ids = ids[good]
            for start in range(0, len(query_ids), 256):
                q = queries[start : start + 256]
                d = _distances(q, rows, metric)
                near_d, near_id = _nearest_columns(d, ids, k)
                all_d = np.concatenate([best_d[start : start + 256], near_d], axis=1)
                all_id = np.concatenate([best_id[start : start + 256], near_id], axis=1)
                order = np.lexsort((all_id, all_d), axis=1)[:, :k]
                best_d[start : start + 256] = np.take_along_axis(all_d, order, 1)
                best_id[start : start + 256] = np.take_along_axis(all_id, order, 1)
        keep = np.isfinite(best_d)
        who = np.repeat(query_ids, k).reshape(best_d.shape)
        yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(best_id[keep]), pa.array(best_d[keep])], names=["query_id", "id", "distance"])

    return top


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this width that hold no null as a matrix, and their rows in the column."""
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)), -1).astype(np.int64)
    good = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(good)).flatten()
    rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(good), width)
    if flat.null_count:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(good), width).all(axis=1)
        rows, good = rows[whole], good[whole]
    return rows, good


def _nearest_columns(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of at least the ``k`` nearest of each row, all that tie with the last of them included."""
    if d.shape[1] <= 4 * k:
        return d, np.broadcast_to(ids, d.shape)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    inside = d <= edge
    widest = int(inside.sum(1).max())
    order = np.argsort(~inside, axis=1, kind="stable")[:, :widest]
    return np.where(np.take_along_axis(inside, order, 1), np.take_along_axis(d, order, 1), np.inf), ids[order]


def _distances(q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ rows.T
    if metric == "cosine":
        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return np.where(length > 0, 1 - dot / np.where(length > 0, length, 1), np.inf)
    squared = (q * q).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * dot
    return np.maximum(squared, 0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def contexts_of(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """``query_id, contexts``: the texts ``(id, text)`` of ranked ids, in order of rank."""
    found = ranked.join(texts.select("id", "text"), "id")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c")).select("query_id", F.col("c.text").alias("contexts"))


@dataclass(frozen=True)
class PromptTemplate:
    """The fixed lines of a prompt; the structure is two instructions, the question, numbered contexts or a notice, a cue."""

    role: str = "Du beantwortest Ernährungsfragen auf der Grundlage von Leitlinien."
    style: str = "Nutze nur den folgenden Kontext und antworte in höchstens vier Absätzen."
    question: str = "Frage: "
    heading: str = "Kontext:"
    notice: str = "Hinweis: Zu dieser Frage liegt kein Kontext vor."
    cue: str = "Antwort:"


def prompt(query: Column | str, contexts: Column | str, template: PromptTemplate = PromptTemplate()) -> Column:
    """The prompt of a query. Null and empty contexts take the notice; null contexts inside are left out."""
    query, contexts = (F.col(c) if isinstance(c, str) else c for c in (query, contexts))
    given = F.filter(F.coalesce(contexts, F.array().cast("array<string>")), lambda x: x.isNotNull())
    numbered = F.transform(given, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    middle = F.when(F.size(given) > 0, F.concat(F.array(F.lit(template.heading)), numbered)).otherwise(F.array(F.lit(template.notice)))
    opening = F.array(F.lit(template.role), F.lit(template.style), F.lit(""), F.concat(F.lit(template.question), F.coalesce(query, F.lit(""))), F.lit(""))
    return F.array_join(F.concat(opening, middle, F.array(F.lit(""), F.lit(template.cue))), "\n")


def batches_of(queries: DataFrame, size: int = 10, order: str = "query_id") -> DataFrame:
    """Adds ``position`` (from 1), ``batch_no`` and the batch's ``first_row`` and ``last_row``.

    Positions come from a range partitioning and the row counts of its partitions, so no task sees all rows.
    """
    numbered = positions(queries, order)
    batch = F.floor((F.col("position") - 1) / size).cast("bigint") + 1
    total = F.col("total")
    out = numbered.withColumn("batch_no", batch)
    return out.withColumn("first_row", (F.col("batch_no") - 1) * size + 1).withColumn("last_row", F.least(F.col("batch_no") * size, total)).drop("total")


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """Rows in ranges of ``order``, with the number of the range and of the row in it; written down, as sampled range bounds
    may differ from one run to the next. Ties are ordered by all columns that can be ordered."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [c for c, t in df.dtypes if c != order and "map<" not in t]
    ranged = df.repartitionByRange(parts, order, *ties).sortWithinPartitions(order, *ties)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _offsets(rows: list, default) -> tuple[dict, object]:
    """Running totals before each range, from ``(range, total)``; there are as many as partitions."""
    out, total = {}, default
    for part, n in sorted(rows):
        out[part] = total
        total += n
    return out, total


def _looked_up(offsets: dict, kind: str) -> Column:
    pairs = [F.lit(x) for pair in offsets.items() for x in pair]
    return (F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)).cast(kind)


def positions(df: DataFrame, order: str) -> DataFrame:
    """Adds the 1-based ``position`` by ``order`` and the ``total`` of all rows; no task sees all rows."""
    ranged = _ranged(df, order)
    offsets, total = _offsets([tuple(r) for r in ranged.groupBy("_part").agg(F.count("*")).collect()], 0)
    return ranged.withColumn("position", _looked_up(offsets, "bigint") + F.col("_row") + 1).withColumn("total", F.lit(total).cast("bigint")).drop("_part", "_row")


def progress(batches: DataFrame, total: int | None = None) -> DataFrame:
    """Per batch of ``batch_no, n, seconds``: running ``processed`` count, ``percent`` (integer floor), ``rate`` and ``eta``.

    Running sums are taken inside ranges of batches and shifted by the totals of the ranges before. A zero time gives a zero
    rate and a zero eta.
    """
    ranged = _ranged(batches, "batch_no")
    sums = ranged.groupBy("_part").agg(F.sum("n").alias("n"), F.sum("seconds").alias("s")).collect()
    counts, whole = _offsets([(r["_part"], r["n"]) for r in sums], 0)
    times, _ = _offsets([(r["_part"], float(r["s"])) for r in sums], 0.0)
    running = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("n").over(running) + _looked_up(counts, "bigint")
    elapsed = F.sum("seconds").over(running) + _looked_up(times, "double")
    whole = whole if total is None else total
    out = ranged.withColumn("processed", done).withColumn("rate", F.coalesce(F.try_divide(done.cast("double"), elapsed), F.lit(0.0)))
    out = out.withColumn("percent", F.floor(100 * F.col("processed") / F.lit(whole)).cast("bigint"))
    return out.withColumn("eta", F.coalesce(F.try_divide(F.lit(whole) - F.col("processed"), F.col("rate")), F.lit(0.0))).drop("_part", "_row")

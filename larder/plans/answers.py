"""Queries of the retrieval, generation and evaluation stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.text import numbers
from larder.operators import evaluation, generation, retrieval
from larder.plans.registry import Registry
from larder.sources import json_io, vectors
from larder.sources.tables import delivered, spread, table

registry = Registry()

RESULTS = """results AS MATERIALIZED (SELECT query_id, query, answer, contexts FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY loaded_at) AS rn FROM rag_results) WHERE rn = 1)"""
DIGITS = r"regexp_extract_all(answer, '\d+')"
FIRST = rf"TRY_CAST(regexp_extract(answer, '\d+') AS HUGEINT)"
CORRECT = f"CASE WHEN {FIRST} BETWEEN 50 AND 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
HAS = r"coalesce(regexp_matches({0}, '[0-9]'), false)"
UNSUPPORTED = f"CASE WHEN {HAS.format('answer')} AND NOT {HAS.format(chr(97) + 'rray_to_string(contexts, ' + chr(39) + ' ' + chr(39) + ')')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

#: Questions of our own as an inline relation.
QUESTIONS = (
    "Wie viel Eisen brauchen Schwangere am Tag?",
    "Welche Lebensmittel liefern Vitamin D im Winter?",
    "Ist zu viel Salz bei Bluthochdruck schädlich?",
    "Wie viel Eiweiß ist nach einer Operation sinnvoll?",
    "Welche Ballaststoffe helfen bei Verstopfung?",
    "Wie viel Wasser sollten ältere Menschen trinken?",
    "Welche Fettsäuren sind für das Herz günstig?",
    "Wie lässt sich der Jodbedarf ohne Fisch decken?",
)


def results(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return delivered(spark, sf_dir, "rag_results", "query_id", *(columns or ("query", "answer", "contexts")))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id 20 divides."""
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return corpus, corpus.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")


_TOP = """SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS id, {0} AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 3"""
_L2 = "list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2"
_COSINE = "1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


def _top(spark: SparkSession, sf_dir: str, metric: str, k: int = 3) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    found = retrieval.nearest(corpus, queries, k + 1, metric).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@registry.add("topk_l2", _TOP.format(_L2))
def topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "l2").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@registry.add("topk_cosine", _TOP.format(_COSINE))
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "cosine").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


_CONTEXTS = f"""WITH top AS ({_TOP.format(_L2)}) SELECT query_id, string_agg(d.text, chr(10) ORDER BY rank) AS contexts, count(*) AS n
FROM top JOIN documents d ON d.doc_id = top.id WHERE d.text IS NOT NULL GROUP BY query_id"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return retrieval.contexts_of(_top(spark, sf_dir, "l2"), texts)


@registry.add("retrieve_contexts", _CONTEXTS)
def retrieve_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("query_id", F.array_join("contexts", "\n").alias("contexts"), F.size("contexts").cast("bigint").alias("n"))


_PROMPT = """SELECT query_id, concat('Du beantwortest Ernährungsfragen auf der Grundlage von Leitlinien.', chr(10), 'Nutze nur den folgenden Kontext und antworte in höchstens vier Absätzen.', chr(10), chr(10),
 'Frage: ', coalesce(query, ''), chr(10), chr(10),
 CASE WHEN len(list_filter(coalesce(contexts, []), lambda x: x IS NOT NULL)) > 0 THEN 'Kontext:' || chr(10) || array_to_string(list_transform(list_filter(contexts, lambda x: x IS NOT NULL), lambda x, i: i || '. ' || x), chr(10))
 ELSE 'Hinweis: Zu dieser Frage liegt kein Kontext vor.' END, chr(10), chr(10), 'Antwort:') AS prompt FROM results"""


@registry.add("build_prompt", f"WITH {RESULTS} {_PROMPT}")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "query", "contexts").select("query_id", retrieval.prompt("query", "contexts").alias("prompt"))


@registry.add("inline_queries", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") t(query_id, query)")
def inline_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")


@registry.add("hash_embed")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding of each document, as its width, length and a checksum."""
    made = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", retrieval.hash_embedding("text").alias("v"))
    return made.select("doc_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"), F.xxhash64("v").alias("checksum"))


@registry.add("vector_index", "SELECT count(*) AS vectors, 64 AS width FROM documents")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and width of a stored vector table, built once and found again by the content of its chunks."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    folder = json_io.scratch_path(spark, "index")
    vectors.load_or_build(spark, source, folder, retrieval.hash_embedding)
    again = vectors.retriever(spark, source, folder, retrieval.hash_embedding)
    return again.agg(F.count("*").alias("vectors"), F.max(F.size("vector")).alias("width"))


@registry.add("generate_stub", f"WITH {RESULTS}, p AS ({_PROMPT}) SELECT p.query_id, coalesce(r.query, '') || ' [' || length(p.prompt) || ']' AS answer, NULL::VARCHAR AS error FROM p JOIN results r ON r.query_id = p.query_id")
def generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.generate(build_prompt(spark, sf_dir))


@registry.add("parse_response", f"""WITH {RESULTS} SELECT query_id, coalesce(CASE WHEN query_id % 7 = 0 THEN NULL ELSE answer END, '[GENERATOR ERROR] ''response''') AS answer FROM results""")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers read back out of a service's JSON, every seventh without its field."""
    key = F.when(F.col("query_id") % 7 == 0, F.lit(None)).otherwise(F.col("answer"))
    raw = F.to_json(F.struct(F.lit("m").alias("model"), key.alias("response")))
    return results(spark, sf_dir, "answer").select("query_id", generation.parsed_response(raw).alias("answer"))


@registry.add("batch_assign", f"""WITH {RESULTS}, p AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS position, count(*) OVER () AS total FROM results)
SELECT query_id, position, (position - 1) // 10 + 1 AS batch_no, (position - 1) // 10 * 10 + 1 AS first_row, least(((position - 1) // 10 + 1) * 10, total) AS last_row FROM p""")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "rag_results").select("query_id").distinct()
    return retrieval.batches_of(ids).select("query_id", "position", "batch_no", "first_row", "last_row")


@registry.add("progress_metrics", f"""WITH {RESULTS}, p AS (SELECT (row_number() OVER (ORDER BY query_id) - 1) // 10 + 1 AS batch_no FROM results),
b AS (SELECT batch_no, count(*) AS n, (count(*) * 0.5)::DOUBLE AS seconds FROM p GROUP BY batch_no),
r AS (SELECT batch_no, sum(n) OVER w AS processed, sum(n) OVER () AS total, sum(seconds) OVER w AS elapsed FROM b WINDOW w AS (ORDER BY batch_no ROWS UNBOUNDED PRECEDING))
SELECT batch_no, processed::BIGINT AS processed, (100 * processed // total)::BIGINT AS percent, round(processed / elapsed, 6) AS rate, round((total - processed) / (processed / elapsed), 6) AS eta FROM r""")
def progress_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress after each batch, at half a second a query."""
    per_batch = batch_assign(spark, sf_dir).groupBy("batch_no").agg(F.count("*").alias("n")).withColumn("seconds", F.col("n") * 0.5)
    done = retrieval.progress(per_batch)
    return done.select("batch_no", "processed", "percent", F.round("rate", 6).alias("rate"), F.round("eta", 6).alias("eta"))


@registry.add("query_preview", f"WITH {RESULTS} SELECT query_id, left(query, 60) AS preview FROM results")
def query_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "query").select("query_id", F.left("query", F.lit(60)).alias("preview"))


@registry.add("rag_results", f"""WITH {RESULTS}, p AS ({_PROMPT}) SELECT p.query_id, r.query, coalesce(r.query, '') || ' [' || length(p.prompt) || ']' AS answer, coalesce(len(r.contexts), 0)::BIGINT AS n_contexts FROM p JOIN results r ON r.query_id = p.query_id""")
def rag_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query, generated answer and contexts of every query, with the stand-in generator."""
    asked = results(spark, sf_dir, "query", "contexts").withColumn("prompt", retrieval.prompt("query", "contexts"))
    answers = generation.generate(asked.withColumn("n_contexts", F.coalesce(F.size("contexts"), F.lit(0)).cast("bigint")), carried=("query", "n_contexts"))
    return answers.select("query_id", "query", "answer", "n_contexts")


@registry.add("extract_numbers", rf"""WITH {RESULTS} SELECT query_id, i::BIGINT AS position, TRY_CAST(x AS HUGEINT)::VARCHAR AS number FROM (
  SELECT query_id, unnest({DIGITS}) AS x, generate_subscripts({DIGITS}, 1) AS i FROM results WHERE answer IS NOT NULL)""")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir, "answer").select("query_id", F.posexplode(numbers("answer")).alias("p", "n"))
    return found.select("query_id", (F.col("p") + 1).cast("bigint").alias("position"), F.col("n").cast("string").alias("number"))


@registry.add("numerical_correctness", f"WITH {RESULTS} SELECT query_id, {CORRECT} AS score FROM results")
def numerical_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "answer").select("query_id", evaluation.numerical_correctness("answer").alias("score"))


@registry.add("unsupported_precision", f"WITH {RESULTS} SELECT query_id, {UNSUPPORTED} AS score FROM results")
def unsupported_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "answer", "contexts").select("query_id", evaluation.unsupported_precision("answer", "contexts").alias("score"))


@registry.add("custom_scores", f"WITH {RESULTS} SELECT query_id, {CORRECT} AS numerical_correctness, {UNSUPPORTED} AS unsupported_precision FROM results")
def custom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "answer", "contexts").select("query_id", evaluation.rule_scores().alias("s")).select("query_id", "s.*")


@registry.add("evaluate_results", f"WITH {RESULTS} SELECT query_id, query, answer, array_to_string(contexts, chr(10)) AS contexts, {CORRECT} AS numerical_correctness, {UNSUPPORTED} AS unsupported_precision FROM results")
def evaluate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluation.evaluated(results(spark, sf_dir))
    return scored.select("query_id", "query", "answer", F.array_join("contexts", "\n").alias("contexts"), "custom_scores.*")


_VERDICTS = "list_transform(regexp_extract_all(coalesce(answer, ''), '[^.!?]+[.!?]'), lambda x: regexp_matches(x, '[0-9]'))"


@registry.add("faithfulness_ratio", rf"WITH {RESULTS}, v AS (SELECT query_id, {_VERDICTS} AS v FROM results) SELECT query_id, round(CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda x: x)) / len(v)::DOUBLE END, 9) AS faithfulness FROM v")
def faithfulness_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supported statements; the stand-in verdict of a sentence is whether it states a number."""
    verdicts = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit("[^.!?]+[.!?]"), F.lit(0)), lambda x: x.rlike("[0-9]"))
    return results(spark, sf_dir, "answer").select("query_id", F.round(evaluation.supported_share(verdicts), 9).alias("faithfulness"))


@registry.add("answer_relevancy_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS relevancy FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def answer_relevancy_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector, as a question, with the next, as one regenerated from its answer."""
    asked = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    again = asked.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return asked.join(again, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("relevancy"))


@registry.add("nan_to_null", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", evaluation.nan_to_null(value).alias("value"))


@registry.add("json_reply_default", f"""WITH {RESULTS} SELECT query_id, CASE WHEN answer IS NULL OR answer = '' THEN '{{}}' ELSE answer END AS reply_a, CASE WHEN answer IS NULL OR trim(answer) = '' THEN '{{"claims": []}}' ELSE answer END AS reply_b FROM results""")
def json_reply_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, "answer").select("query_id", generation.reply_or("answer").alias("reply_a"), generation.reply_or("answer", '{"claims": []}', blank=True).alias("reply_b"))


@registry.add("judge_stub")
def judge_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two stand-in judges and of the rules."""
    scored = evaluation.evaluated(results(spark, sf_dir), generation.stub_judge, generation.stub_judge)
    flat = [F.col(f"judge_{x}_scores.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("faithfulness", "relevancy", "error")]
    return scored.select("query_id", *flat, "custom_scores.*")


def _joined(column: str) -> str:
    return f"array_to_string({column}, chr(10))"


@registry.add("results_roundtrip", f"WITH {RESULTS} SELECT query_id, query, answer, {_joined('contexts')} AS contexts FROM results")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = json_io.scratch_path(spark, "results")
    json_io.write_lines(results(spark, sf_dir), path)
    return json_io.read_lines(spark, path, json_io.RESULT).select("query_id", "query", "answer", F.array_join("contexts", "\n").alias("contexts"))


@registry.add("evaluated_roundtrip", f"WITH {RESULTS} SELECT query_id, answer, {CORRECT} AS numerical_correctness, {UNSUPPORTED} AS unsupported_precision FROM results")
def evaluated_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = json_io.scratch_path(spark, "evaluated")
    json_io.write_lines(evaluation.evaluated(results(spark, sf_dir, "query", "answer", "contexts")), path)
    return json_io.read_lines(spark, path, json_io.EVALUATED).select("query_id", "answer", "custom_scores.*")

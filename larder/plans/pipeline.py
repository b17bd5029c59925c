"""The whole way from files to evaluated answers, with the generator and the judges passed in."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.page import decoded, page_text, page_text_by_density
from larder.functions.text import clean, markdown_table
from larder.operators import chunking, cleaning, evaluation, generation, retrieval
from larder.plans.answers import QUESTIONS
from larder.plans.registry import Registry
from larder.sources import files, pdf
from larder.sources.tables import spread, table

registry = Registry()


@dataclass(frozen=True)
class Settings:
    """What may be chosen for a run. ``of`` reads the numbers from the session (``larder.chunk_size``) and, where it has none,
    from the environment (``LARDER_CHUNK_SIZE``)."""

    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    top_k: int = retrieval.TOP_K
    in_flight: int = generation.IN_FLIGHT
    by_density: bool = True
    template: retrieval.PromptTemplate = field(default_factory=retrieval.PromptTemplate)

    @classmethod
    def of(cls, spark: SparkSession, environment: Mapping[str, str] = os.environ) -> Settings:
        found = {f.name: spark.conf.get(f"larder.{f.name}", environment.get(f"LARDER_{f.name.upper()}")) for f in fields(cls) if f.type == "int"}
        return cls(**{name: int(value) for name, value in found.items() if value is not None})


def chunks_of_files(scanned: DataFrame, pages: Callable[[bytes], list[str]] = pdf.pages, tables: Callable[[bytes], list[list[list[str]]]] = pdf.tables, root: str = "", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, part_no, chunk_no, text, metadata, error`` of scanned files: HTML by tiers, PDF by pages, PDF_table by tables.

    A file that cannot be read is a row with its error and no text. Any reader of PDF may be passed in.
    """
    scanned = scanned.withColumn("doc_id", F.xxhash64("path"))
    html = scanned.where("doc_type = 'HTML'").select("doc_id", clean((page_text_by_density if settings.by_density else page_text)(decoded("content"))).alias("text"), F.lit(None).cast("string").alias("error"))
    read = files.read_pages(scanned.where("doc_type = 'PDF'"), pages).withColumn("doc_id", F.xxhash64("path"))
    good = cleaning.clean_documents(read.where("error is null").select("doc_id", "page_no", "text")).withColumn("error", F.lit(None).cast("string"))
    bad = read.where("error is not null").select("doc_id", F.lit(None).cast("string").alias("text"), "error")
    cells = files.read_pages(scanned.where("doc_type = 'PDF_table'"), lambda content: [_as_json(t) for t in tables(content)]).withColumn("doc_id", F.xxhash64("path"))
    markdown = markdown_table(F.from_json("text", "array<array<string>>"))
    listed = F.array_sort(F.collect_list(F.when(markdown.isNotNull(), F.struct("page_no", markdown.alias("m")))))
    tabled = cells.groupBy("doc_id").agg(F.array_join(listed["m"], "\n\n").alias("text"), F.max("error").alias("error"))
    texts = html.unionByName(good, True).unionByName(bad, True).unionByName(tabled, True).fillna(0, ["part_no"])
    meta = scanned.select("doc_id", files.metadata_of("path", "doc_type", root).alias("metadata"))
    known = texts.join(meta, "doc_id")
    cut = chunking.chunk_documents(known.where("error is null").select("doc_id", "part_no", "text", "metadata"), settings.chunk_size, settings.chunk_overlap, "metadata")
    return cut.withColumn("error", F.lit(None).cast("string")).unionByName(known.where("error is not null").select("doc_id", "part_no", "metadata", F.lit(0).alias("chunk_no"), "text", "error"))


def _as_json(rows: list[list[str]]) -> str:
    import json

    return json.dumps([[None if c is None else str(c) for c in row] for row in rows], ensure_ascii=False)


def answers_to(queries: DataFrame, chunks: DataFrame, embed=retrieval.hash_embedding, generator=generation.echo_generator, settings: Settings = Settings()) -> DataFrame:
    """``query_id, query, answer, contexts, error`` of ``queries(query_id, query)`` over ``chunks(id, text)``."""
    corpus = chunks.select("id", embed("text").alias("vector"))
    asked = queries.select("query_id", embed("query").alias("vector"))
    ranked = retrieval.nearest(corpus, asked, settings.top_k)
    known = queries.join(retrieval.contexts_of(ranked, chunks), "query_id", "left")
    prompts = known.select("query_id", "query", "contexts", retrieval.prompt("query", "contexts", settings.template).alias("prompt"))
    return generation.generate(prompts, generator, settings.in_flight, ("query", "contexts")).select("query_id", "query", "answer", "contexts", "error")


@registry.add("pipeline_end_to_end")
def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks, embedded, searched for our own questions, answered and scored by the stand-ins."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean("text").alias("text"))
    chunks = chunking.chunk_documents(documents).select((F.col("doc_id") * 1000 + F.col("chunk_no")).alias("id"), "text")
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "query_id bigint, query string")
    scored = evaluation.evaluated(answers_to(queries, chunks), generation.stub_judge, generation.stub_judge)
    return scored.select("query_id", "query", "answer", F.size("contexts").alias("contexts"), "judge_a_scores.faithfulness", "judge_b_scores.relevancy", "custom_scores.*")

"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import boilerplate, canonical, encoding, leakage, neardup, pairs, privacy, scans, splitting, sql
from larder.plans.registry import Registry
from larder.sources.tables import table

registry = Registry()


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "nutrient_recommendation").select("rec_id", "nutrient").where("nutrient <> ''")
    aliases = table(spark, sf_dir, "nutrient_alias").select("alias", F.col("nutrient_id").alias("entry_id"))
    exact = aliases.select(F.col("alias").alias("nutrient")).union(aliases.select("entry_id")).distinct()
    free = records.join(exact, "nutrient", "left_anti")
    values = free.groupBy(F.col("nutrient").alias("value")).agg(F.count("*").alias("records"))
    return free, canonical.match_values(values, aliases)


@registry.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, nutrient_id (or ``unmatched``) of every record whose nutrient is no entry of the list as it stands."""
    free, matches = _matched(spark, sf_dir)
    named = free.distinct().join(matches.select(F.col("value").alias("nutrient"), "entry_id"), "nutrient")
    return named.select("rec_id", F.coalesce("entry_id", F.lit("unmatched")).alias("nutrient_id")).distinct()


@registry.add("p2_unmatched")
def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with the number of records of each."""
    free, matches = _matched(spark, sf_dir)
    counted = free.distinct().groupBy("nutrient").agg(F.count("*").alias("records"))
    return counted.join(matches.where("entry_id is null").select(F.col("value").alias("nutrient")), "nutrient").select("nutrient", "records")


@registry.add("p3_found", sql.NEAR_COPIES)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id_a, chunk_id_b of every pair of near copies."""
    return neardup.found_pairs(table(spark, sf_dir, "all_chunks"))


@registry.add("p3_classes", sql.CLASSES)
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, class_id, links of every chunk with three words or more; the class is that of its near copies."""
    return neardup.classes(table(spark, sf_dir, "all_chunks"))


@registry.add("p7_found", sql.OVERSIZED)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id of every item that was cut, which is every oversized one."""
    return splitting.pieces_of(table(spark, sf_dir, "all_chunks")).select("chunk_id").distinct()


@registry.add("p7_pieces")
def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item with its metadata as flat columns."""
    pieces = splitting.pieces_of(table(spark, sf_dir, "all_chunks"))
    return pieces.select("chunk_id", "piece_no", "pieces", "start", "end", "text", "over_limit", "metadata.folder", "metadata.doc_type", "metadata.source")


@registry.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return encoding.token_ids(table(spark, sf_dir, "documents"))


@registry.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id of every document that gives away an item."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")).select("doc_id", "item_id")


@registry.add("p9_items")
def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item: documents that hold it, and the longest run of words."""
    found = leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_run"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.pages_of(table(spark, sf_dir, "all_chunks"), table(spark, sf_dir, "source_files"))


@registry.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, line_no of every line of a web page that is not part of its main body."""
    return boilerplate.furniture_lines(_pages(spark, sf_dir)).distinct()


@registry.add("p4_bodies")
def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each web page."""
    return boilerplate.main_bodies(_pages(spark, sf_dir))


@registry.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, line_no, kind of every noisy line of a scanned page."""
    return scans.scan_defects(table(spark, sf_dir, "all_chunks"))


@registry.add("p5_texts")
def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned text as continuous paragraphs."""
    return scans.repaired_texts(table(spark, sf_dir, "all_chunks"))


@registry.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, defect of every defective pair."""
    return pairs.pair_defects(table(spark, sf_dir, "rag_results"))


@registry.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, value of every distinct detail of a private person."""
    return privacy.details(table(spark, sf_dir, "documents"))


@registry.add("p10_texts")
def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with such details replaced by placeholders."""
    return privacy.masked_texts(table(spark, sf_dir, "documents"))

"""Queries of the guideline-matching stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import guidelines
from larder.plans.registry import Registry
from larder.sources.tables import delivered, table

registry = Registry()

RECORDS = """records AS MATERIALIZED (SELECT rec_id, nutrient, amount, unit, timeframe, recommendation_type, source, population_group.sex AS sex, population_group.age_min AS age_min,
  population_group.age_max AS age_max, population_group.life_stage AS life_stage, population_group IS NULL AS no_group FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) AS rn FROM nutrient_recommendation) WHERE rn = 1)"""
SAME_GROUP = "{0}.no_group = {1}.no_group AND {0}.sex IS NOT DISTINCT FROM {1}.sex AND {0}.age_min IS NOT DISTINCT FROM {1}.age_min AND {0}.age_max IS NOT DISTINCT FROM {1}.age_max AND {0}.life_stage IS NOT DISTINCT FROM {1}.life_stage"
STATUS = """CASE WHEN {0} = {1} AND {0} IN ('target', 'range', 'adequate_intake') THEN 'full' WHEN {0} IN ('target', 'adequate_intake') AND {1} IN ('target', 'adequate_intake') THEN 'full' ELSE 'partial' END"""
DAYS = "CASE timeframe WHEN 'per_day' THEN 1 WHEN 'per_week' THEN 7 WHEN 'per_month' THEN 30 END"


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return delivered(spark, sf_dir, "nutrient_recommendation", "rec_id", *columns)


@registry.add("nutrient_vocab", f"WITH {RECORDS} SELECT rec_id, nutrient FROM records WHERE nutrient IN (SELECT nutrient_id FROM nutrient_alias)")
def nutrient_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose nutrient is a canonical id."""
    ids = table(spark, sf_dir, "nutrient_alias").select(F.col("nutrient_id").alias("nutrient")).distinct()
    return records(spark, sf_dir, "nutrient").join(ids, "nutrient", "left_semi")


@registry.add("nutrient_alias_exact", f"WITH {RECORDS}, a AS (SELECT alias, min(nutrient_id) AS nutrient_id FROM nutrient_alias GROUP BY alias) SELECT rec_id, r.nutrient, a.nutrient_id FROM records r LEFT JOIN a ON a.alias = r.nutrient")
def nutrient_alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guidelines.canonical_nutrient(records(spark, sf_dir, "nutrient"), table(spark, sf_dir, "nutrient_alias"), fold=False)
    return found.select("rec_id", "nutrient", "nutrient_id")


@registry.add("nutrient_alias_fold", f"""WITH {RECORDS}, a AS (SELECT alias, min(nutrient_id) AS nutrient_id FROM nutrient_alias GROUP BY alias), f AS (SELECT lower(trim(alias)) AS alias, min(nutrient_id) AS nutrient_id FROM nutrient_alias GROUP BY 1),
i AS (SELECT DISTINCT nutrient_id FROM nutrient_alias)
SELECT rec_id, r.nutrient, coalesce(a.nutrient_id, f.nutrient_id, i.nutrient_id) AS nutrient_id FROM records r LEFT JOIN a ON a.alias = r.nutrient LEFT JOIN f ON f.alias = lower(trim(r.nutrient)) LEFT JOIN i ON i.nutrient_id = lower(trim(r.nutrient))""")
def nutrient_alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guidelines.canonical_nutrient(records(spark, sf_dir, "nutrient"), table(spark, sf_dir, "nutrient_alias"))
    return found.select("rec_id", "nutrient", "nutrient_id")


_TARGET = "CASE rec_id % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'µg' WHEN 2 THEN 'kJ' ELSE unit END"


@registry.add("normalize_amount", f"""WITH {RECORDS}, r AS (SELECT rec_id, amount, unit, {_TARGET} AS target_unit FROM records),
j AS (SELECT r.*, u.dimension AS d1, u.factor_to_base AS f1, t.dimension AS d2, t.factor_to_base AS f2, coalesce(r.unit IN ('%E', '%DV', 'portions', 'IU'), false) OR coalesce(r.target_unit IN ('%E', '%DV', 'portions', 'IU'), false) AS custom
  FROM r LEFT JOIN measure_unit u ON u.unit = translate(r.unit, 'μ', 'µ') LEFT JOIN measure_unit t ON t.unit = translate(r.target_unit, 'μ', 'µ'))
SELECT rec_id, round(CASE WHEN custom AND unit = target_unit THEN amount WHEN NOT custom AND d1 = d2 THEN amount * f1 / f2 END, 9) AS converted,
 NOT coalesce((custom AND unit = target_unit) OR (NOT custom AND d1 = d2), false) AS failed FROM j""")
def normalize_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in another unit, which the record id chooses."""
    target = F.when(F.col("rec_id") % 4 == 0, "g").when(F.col("rec_id") % 4 == 1, "µg").when(F.col("rec_id") % 4 == 2, "kJ").otherwise(F.col("unit"))
    asked = records(spark, sf_dir, "amount", "unit").select("rec_id", "amount", "unit", target.alias("target_unit"))
    done = guidelines.convert_amounts(asked, table(spark, sf_dir, "measure_unit"))
    return done.select("rec_id", F.round("converted", 9).alias("converted"), F.col("error").isNotNull().alias("failed"))


@registry.add("normalize_to_daily", f"WITH {RECORDS} SELECT rec_id, round(amount / {DAYS}, 9) AS daily, {DAYS} IS NULL AS failed FROM records")
def normalize_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = records(spark, sf_dir, "amount", "timeframe").select("rec_id", guidelines.daily("amount", "timeframe").alias("d"))
    return done.select("rec_id", F.round("d.amount", 9).alias("daily"), F.col("d.error").isNotNull().alias("failed"))


@registry.add("compatibility", f"""WITH {RECORDS}, t AS (SELECT DISTINCT recommendation_type AS t FROM records) SELECT a.t AS type_a, b.t AS type_b, {STATUS.format('a.t', 'b.t')} AS status FROM t a, t b""")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the recommendation types, of which there are a handful."""
    types = table(spark, sf_dir, "nutrient_recommendation").agg(F.collect_set("recommendation_type").alias("t"))
    pairs = types.select(F.explode("t").alias("type_a"), "t").select("type_a", F.explode("t").alias("type_b"))
    return pairs.select("type_a", "type_b", guidelines.compatibility("type_a", "type_b").alias("status"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Extracted records are those of the sources that are named so, guidelines those of the large collections."""
    every = records(spark, sf_dir, "nutrient", "population_group", "recommendation_type", "source").where("nutrient is not null")
    return every.where(F.col("source").startswith("rag_output")), every.where(F.col("source").startswith("leitwerte"))


@registry.add("compare_guidelines", f"""WITH {RECORDS}, e AS (SELECT * FROM records WHERE starts_with(source, 'rag_output') AND nutrient IS NOT NULL), g AS (SELECT * FROM records WHERE starts_with(source, 'leitwerte') AND nutrient IS NOT NULL)
SELECT e.rec_id AS rag_rec_id, g.rec_id AS guideline_rec_id, CASE WHEN g.rec_id IS NULL THEN 'no_guideline' ELSE {STATUS.format('e.recommendation_type', 'g.recommendation_type')} END AS status
FROM e LEFT JOIN g ON e.nutrient = g.nutrient AND {SAME_GROUP.format('e', 'g')}""")
def compare_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidelines.compare(*_sides(spark, sf_dir))


@registry.add("guideline_lists", f"""WITH {RECORDS} SELECT nutrient, no_group, sex, age_min, age_max, life_stage, rec_id FROM records
WHERE starts_with(source, 'leitwerte') AND nutrient IS NOT NULL""")
def guideline_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists of guidelines of each nutrient and group hold."""
    made = guidelines.guideline_lists(_sides(spark, sf_dir)[1])
    group = [F.col(f"population_group.{c}").alias(c) for c in ("sex", "age_min", "age_max", "life_stage")]
    return made.select("nutrient", F.col("population_group").isNull().alias("no_group"), *group, F.explode("rec_ids").alias("rec_id"))


@registry.add("guideline_index", f"""WITH {RECORDS} SELECT nutrient, no_group, sex, age_min, age_max, life_stage, count(*) AS guidelines, min(rec_id) AS first_rec_id, max(rec_id) AS last_rec_id FROM records
WHERE starts_with(source, 'leitwerte') AND nutrient IS NOT NULL GROUP BY ALL""")
def guideline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = guidelines.guideline_index(_sides(spark, sf_dir)[1])
    group = [F.col(f"population_group.{c}").alias(c) for c in ("sex", "age_min", "age_max", "life_stage")]
    return made.select("nutrient", F.col("population_group").isNull().alias("no_group"), *group, "guidelines", "first_rec_id", "last_rec_id")

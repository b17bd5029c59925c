"""Matching extracted recommendations against guidelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a time frame; meals and servings have none.
TIMEFRAME_DAYS = {"per_day": 1, "per_week": 7, "per_month": 30}
#: Compatibility of two recommendation types, in either order.
COMPATIBILITY = {
    ("target", "target"): "full",
    ("target", "adequate_intake"): "full",
    ("target", "range"): "partial",
    ("range", "range"): "full",
    ("range", "adequate_intake"): "partial",
    ("adequate_intake", "adequate_intake"): "full",
}
#: Units that convert to nothing but themselves.
CUSTOM_UNITS = ("%E", "%DV", "portions", "IU")


def canonical_nutrient(records: DataFrame, aliases: DataFrame, fold: bool = True) -> DataFrame:
    """Adds ``nutrient_id``: by the alias as written; with ``fold`` also by the alias without case and outer blanks, then by
    the id itself. Null without one. The alias table is a dimension, whose side Spark broadcasts by its own estimate."""
    exact = aliases.groupBy("alias").agg(F.min("nutrient_id").alias("exact_id")).withColumnRenamed("alias", "nutrient")
    out = records.join(exact, "nutrient", "left")
    if not fold:
        return out.withColumnRenamed("exact_id", "nutrient_id")
    folded = aliases.groupBy(F.lower(F.trim("alias")).alias("_key")).agg(F.min("nutrient_id").alias("fold_id"))
    known = aliases.select(F.col("nutrient_id").alias("_id")).distinct()
    keyed = out.withColumn("_key", F.lower(F.trim("nutrient")))
    both = keyed.join(folded, "_key", "left").join(known, F.col("_key") == F.col("_id"), "left")
    return both.withColumn("nutrient_id", F.coalesce("exact_id", "fold_id", "_id")).drop("_key", "_id", "exact_id", "fold_id")


def _one_micro(unit: str) -> Column:
    """A unit with the Greek letter, which composed text has, written as the micro sign."""
    return F.translate(unit, "\u03bc", "\u00b5")


def convert_amounts(records: DataFrame, units: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``converted`` and ``error`` to rows of ``amount, unit, target_unit``.

    Units of one dimension convert by their factors; custom units only to themselves; anything else is an error, which
    ``strict`` raises. Both code points of the micro sign are the same.
    """
    known = units.groupBy(_one_micro("unit").alias("_u")).agg(F.min("dimension").alias("_d"), F.min("factor_to_base").alias("_f"))
    side = lambda x: known.select(F.col("_u").alias(f"_{x}"), F.col("_d").alias(f"_{x}_dim"), F.col("_f").alias(f"_{x}_f"))
    keyed = records.withColumn("_unit", _one_micro("unit")).withColumn("_target_unit", _one_micro("target_unit"))
    joined = keyed.join(side("unit"), "_unit", "left").join(side("target_unit"), "_target_unit", "left")
    custom = F.coalesce(F.col("unit").isin(*CUSTOM_UNITS), F.lit(False)) | F.coalesce(F.col("target_unit").isin(*CUSTOM_UNITS), F.lit(False))
    same = F.coalesce(F.col("unit") == F.col("target_unit"), F.lit(False))
    measured = ~custom & (F.col("_unit_dim") == F.col("_target_unit_dim"))
    converted = F.when(custom & same, F.col("amount")).when(measured, F.col("amount") * F.col("_unit_f") / F.col("_target_unit_f"))
    bad = F.coalesce(~((custom & same) | measured), F.lit(True))
    message = F.concat(F.lit("cannot convert "), F.coalesce("unit", F.lit("null")), F.lit(" to "), F.coalesce("target_unit", F.lit("null")))
    value = F.when(bad, F.raise_error(message).cast("double")).otherwise(converted) if strict else converted
    return joined.withColumn("converted", value).withColumn("error", F.when(bad, message)).drop("_unit", "_target_unit", "_unit_dim", "_unit_f", "_target_unit_dim", "_target_unit_f")


def days_of(timeframe: Column | str) -> Column:
    timeframe = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    out = F.lit(None).cast("int")
    for name, days in TIMEFRAME_DAYS.items():
        out = F.when(timeframe == name, days).otherwise(out)
    return out


def daily(amount: Column | str, timeframe: Column | str, strict: bool = False) -> Column:
    """An amount per day as ``struct<amount, error>``; meals, servings and null have an error."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    timeframe = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    days = days_of(timeframe)
    message = F.concat(F.lit("no days for "), F.coalesce(timeframe, F.lit("null")))
    value = F.when(days.isNull(), F.raise_error(message).cast("double")).otherwise(amount / days) if strict else amount / days
    return F.struct(value.alias("amount"), F.when(days.isNull(), message).alias("error"))


def compatibility(a: Column | str, b: Column | str) -> Column:
    """Compatibility of two recommendation types; partial for unknown ones."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    out = F.lit("partial")
    for (x, y), status in COMPATIBILITY.items():
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), status).otherwise(out)
    return out


def compare(extracted: DataFrame, guidelines: DataFrame) -> DataFrame:
    """``rag_rec_id, guideline_rec_id, status``: every extracted record with each guideline of the same nutrient and
    population group, null groups being equal; ``no_guideline`` without one.

    A null-safe left join, whose build side Spark chooses. Types are compared, not whole records.
    """
    left = extracted.select(F.col("rec_id").alias("rag_rec_id"), "nutrient", "population_group", F.col("recommendation_type").alias("_a"))
    right = guidelines.select(F.col("rec_id").alias("guideline_rec_id"), F.col("nutrient").alias("_n"), F.col("population_group").alias("_g"), F.col("recommendation_type").alias("_b"))
    matched = left.join(right, left.nutrient.eqNullSafe(right._n) & left.population_group.eqNullSafe(right._g), "left")
    status = F.when(F.col("guideline_rec_id").isNull(), "no_guideline").otherwise(compatibility("_a", "_b"))
    return matched.select("rag_rec_id", "guideline_rec_id", status.alias("status"))


def guideline_index(guidelines: DataFrame) -> DataFrame:
    """Guidelines of each nutrient and group: the smallest and largest id and their number, combined before the shuffle."""
    return guidelines.groupBy("nutrient", "population_group").agg(F.count("*").alias("guidelines"), F.min("rec_id").alias("first_rec_id"), F.max("rec_id").alias("last_rec_id"))


#: Guidelines in one list of the multimap, about.
LISTED = 1000


def guideline_lists(guidelines: DataFrame, most: int = LISTED) -> DataFrame:
    """``nutrient, population_group, list_no, rec_ids``: the guidelines of each key in ascending order.

    A key with more than ``most`` guidelines has several lists, into which its ids are dealt by their hash, so that a key
    that holds a large part of all rows fills no task; the keys are counted first, combined before the shuffle.
    """
    key = ["nutrient", "population_group"]
    sizes = guidelines.groupBy(*key).agg(F.floor((F.count("*") - 1) / most).cast("int").alias("last"))
    left, right = guidelines.select(*key, "rec_id"), sizes.select(F.col("nutrient").alias("_n"), F.col("population_group").alias("_g"), "last")
    dealt = left.join(right, left.nutrient.eqNullSafe(right._n) & left.population_group.eqNullSafe(right._g))
    number = F.pmod(F.xxhash64("rec_id"), F.col("last") + 1).cast("int")
    return dealt.groupBy(*key, number.alias("list_no")).agg(F.sort_array(F.collect_list("rec_id")).alias("rec_ids"))

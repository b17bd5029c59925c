"""Queries of problem 1: amounts per day in base units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.units import daily_amounts
from larder.plans.registry import Registry
from larder.sources.tables import table

registry = Registry()


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_amounts(table(spark, sf_dir, "nutrient_recommendation"), table(spark, sf_dir, "measure_unit"))


@registry.add("p1_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, dimension, amount_base of every record that states an amount per day."""
    return _amounts(spark, sf_dir).where(F.col("amount_base").isNotNull()).select("rec_id", "dimension", "amount_base")


@registry.add("p1_unstated")
def unstated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the other records state none: reason, number of records."""
    return _amounts(spark, sf_dir).where(F.col("amount_base").isNull()).groupBy("reason").agg(F.count("*").alias("records"))

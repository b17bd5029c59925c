"""Quantities recorded in different units, brought to amounts per day in base units."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.quantity import Lexicon, daily_factor
from larder.sources.tables import bounded_rows

#: Fixed value: the reason of amounts that no bigint holds.
OUT_OF_RANGE = "out of range"
#: Most texts that a Python worker remembers; beyond it, it forgets all and parses again.
REMEMBERED = 200_000


def lexicon_of(measure_unit: DataFrame) -> Lexicon:
    """The unit table is a dimension of plain codes; more than a bounded number of rows is refused."""
    rows = bounded_rows(measure_unit.select("unit", "dimension", "factor_to_base"))
    if rows is None:
        raise ValueError("the unit table has too many rows to be a table of plain unit codes")
    return Lexicon([tuple(r) for r in rows])


def _as_doubles(dimension: str | None, factor: Fraction | None, reason: str | None) -> tuple:
    """Dimension, numerator, denominator and reason; a factor beyond doubles is out of range."""
    if factor is None:
        return dimension, None, None, reason
    try:
        return dimension, float(factor.numerator), float(factor.denominator), reason
    except OverflowError:
        return None, None, None, OUT_OF_RANGE


def daily_amounts(records: DataFrame, measure_unit: DataFrame, key: str = "rec_id") -> DataFrame:
    """``key, dimension, amount_base, reason`` of every record, once per key.

    A narrow map: unit and timeframe are parsed by a grammar in Arrow batches, where each distinct pair is parsed once per
    worker, and the arithmetic stays in the JVM. No shuffle but the one that counts re-delivered rows once, which carries
    four short columns and is combined before it; hot sources or units therefore cannot skew it.

    Defined results: a null or NaN amount has the reason ``no amount``; null or blank unit and timeframe state nothing, and
    no span means a day; contradictory spans or units give a reason and no amount; amounts are rounded half up, in doubles,
    and one that no bigint holds is ``out of range``; records that
    differ under one key give the smallest row; extra columns are ignored; an empty table gives an empty result.
    """
    lexicon = lexicon_of(measure_unit)

    @F.pandas_udf("dimension string, num double, den double, reason string")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for units, spans in batches:
            out = []
            for pair in zip(units, spans):
                got = known.get(pair)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    got = known[pair] = _as_doubles(*daily_factor(*pair, lexicon))
                out.append(got)
            yield pd.DataFrame(out, columns=["dimension", "num", "den", "reason"])

    amount = F.when(F.isnan("amount") | (F.abs("amount") == float("inf")), None).otherwise(F.col("amount"))
    read = records.select(key, amount.alias("amount"), parsed("unit", "timeframe").alias("p"))
    base = F.when(F.col("p.reason").isNull(), F.round(F.col("amount") * F.col("p.num") / F.col("p.den")).try_cast("bigint"))
    known = read.select(key, "amount", "p", base.alias("base"))
    return known.select(
        key,
        F.when(F.col("base").isNotNull(), F.col("p.dimension")).alias("dimension"),
        F.col("base").alias("amount_base"),
        F.when(F.col("amount").isNull(), "no amount").when(F.col("base").isNull(), F.coalesce("p.reason", F.lit(OUT_OF_RANGE))).alias("reason"),
    ).groupBy(key).agg(F.min(F.struct("dimension", "amount_base", "reason")).alias("r")).select(key, "r.*")

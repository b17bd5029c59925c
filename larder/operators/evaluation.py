"""Scores of answers by rules, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import numbers

#: The band in which an answer's first number is plausible.
LOWEST, HIGHEST = 50, 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numerical_correctness(answer: Column | str) -> Column:
    """1.0 if the first number of an answer lies in the band, else 0.0, also for no number and null."""
    first = F.try_element_at(numbers(answer), F.lit(1))
    return F.when(first.between(LOWEST, HIGHEST), 1.0).otherwise(0.0)


def unsupported_precision(answer: Column | str, contexts: Column | str) -> Column:
    """1.0 if an answer has a number and its contexts have none, else 0.0."""
    joined = F.array_join(F.coalesce(_col(contexts), F.array().cast("array<string>")), " ")
    has = lambda c: F.coalesce(c.rlike(r"\d"), F.lit(False))
    return F.when(has(_col(answer)) & ~has(joined), 1.0).otherwise(0.0)


def rule_scores(answer: Column | str = "answer", contexts: Column | str = "contexts") -> Column:
    return F.struct(numerical_correctness(answer).alias("numerical_correctness"), unsupported_precision(answer, contexts).alias("unsupported_precision"))


def supported_share(verdicts: Column | str) -> Column:
    """Share of true verdicts; null for none. Null verdicts count as not supported."""
    verdicts = _col(verdicts)
    return F.try_divide(F.size(F.filter(verdicts, lambda v: F.coalesce(v, F.lit(False)))).cast("double"), F.nullif(F.size(verdicts), F.lit(0)))


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def evaluated(results: DataFrame, judge_a=None, judge_b=None) -> DataFrame:
    """Results with the score structs of two judges and of the rules; without judges only the rules."""
    from larder.operators.generation import judged

    out = results
    for name, judge in (("judge_a_scores", judge_a), ("judge_b_scores", judge_b)):
        out = judged(out, name, judge) if judge else out
    return out.withColumn("custom_scores", rule_scores())

import math
from fractions import Fraction

import pytest

from larder.functions.quantity import Lexicon, convert, daily_factor, number
from larder.operators.units import daily_amounts

UNITS = [("µg", "mass", 1.0), ("mg", "mass", 1e3), ("g", "mass", 1e6), ("kg", "mass", 1e9), ("kcal", "energy", 4184.0), ("kJ", "energy", 1000.0), ("MJ", "energy", 1e6), ("ml", "volume", 1e3), ("dl", "volume", 1e5), ("l", "volume", 1e6), ("IU", "activity", 1.0), ("%E", "none", None), ("portions", "none", None)]
LEXICON = Lexicon(UNITS)


@pytest.mark.parametrize(
    ("unit", "timeframe", "dimension", "factor"),
    [
        ("mg", "per_day", "mass", 1000),
        ("Mg", None, "mass", 1000),
        ("μ g", "", "mass", 1),
        ("µg.", "PER_DAY", "mass", 1),
        ("MCG", "per_week", "mass", Fraction(1, 7)),
        ("x10 mg täglich", None, "mass", 10_000),
        ("Tsd. I.U.", "per_month", "activity", Fraction(1000, 30)),
        ("Internationale Einheiten/d", None, "activity", 1),
        ("100 mg/Woche", "per_week", "mass", Fraction(100_000, 7)),
        ("", "mg a month", "mass", Fraction(1000, 30)),
        ("mg", "alle zwei Tage", "mass", 500),
        ("mg", "every other day", "mass", 500),
        ("mg", "2 × pro Tag", "mass", 2000),
        ("mg", "twice a day", "mass", 2000),
        ("kJ", "zweimal täglich", "energy", 2000),
        ("kilocalories", "weekly", "energy", Fraction(4184, 7)),
        ("Ltr.", "daily", "volume", 1_000_000),
        ("1.000 mg", None, "mass", 1_000_000),
    ],
)
def test_stated(unit, timeframe, dimension, factor):
    assert daily_factor(unit, timeframe, LEXICON) == (dimension, factor, None)


@pytest.mark.parametrize(("unit", "timeframe"), [("mg", "per_meal"), ("mg", "je Portion"), ("%E", None), ("% der Energie", "per_day"), ("Portionen", "per_day"), ("Esslöffel", "per_week"), (None, None), ("", "per_day"), ("siehe Tabelle", None), ("mg/kg", "per_day"), ("mg/Woche", "per_day"), ("mg", "manchmal")])
def test_unstated(unit, timeframe):
    dimension, factor, reason = daily_factor(unit, timeframe, LEXICON)
    assert dimension is None and factor is None and reason


def test_numbers_and_conversion():
    assert number("1,5") == Fraction(3, 2) and number("1.000") == 1000 and number("1.234,5") == Fraction(12345, 10) and number("0.125") == Fraction(1, 8)
    assert convert(500, "mg", "g", LEXICON) == 0.5
    assert convert(1, "kcal", "kJ", LEXICON) == 4.184
    assert convert(1, "g", "ml", LEXICON) is None
    assert math.isclose(convert(20, "°C", "°F", LEXICON), 68)


def test_daily_amounts(spark):
    schema = "rec_id bigint, amount double, unit string, timeframe string, dimension string"
    rows = [(1, 14.0, "mg", "per_week", "x"), (1, 14.0, "mg", "per_week", "x"), (2, None, "mg", "per_day", "x"), (3, float("nan"), "mg", None, "x"), (4, 2.5, "µg", None, "x"), (5, 1.0, None, None, None), (6, 5.0, "mg " * 4000, None, None)]
    units = spark.createDataFrame(UNITS, "unit string, dimension string, factor_to_base double")
    out = {r["rec_id"]: r for r in daily_amounts(spark.createDataFrame(rows, schema), units).collect()}
    assert len(out) == 6 and out[1]["amount_base"] == 2000 and out[1]["dimension"] == "mass"
    assert out[2]["reason"] == out[3]["reason"] == "no amount" and out[2]["amount_base"] is None
    assert out[4]["amount_base"] == 3 and out[5]["reason"] == "no unit" and out[6]["amount_base"] is None
    assert daily_amounts(spark.createDataFrame([], schema), units).count() == 0


@pytest.mark.parametrize(
    ("unit", "stated"),
    [
        ("mg²", None), ("kcal^2", None), ("g/m²", None), ("0^-2 mg", None), ("^2 mg", None), ("mg^", None), ("mg^999999999", None), ("9" * 5000 + " mg", None),
        ("mg^1", ("mass", 1000)), ("10^2 mg", ("mass", 100_000)), ("10^-3 g", ("mass", 1000)), ("10⁻³ g", ("mass", 1000)), ("2 10^3 mg", ("mass", 2_000_000)), ("0^2 mg", ("mass", 0)), ("10^99 mg", ("mass", 10**102)), ("mg²/mg", ("mass", 1000)),
    ],
)
def test_exponents(unit, stated):
    dimension, factor, reason = daily_factor(unit, None, LEXICON)
    assert (dimension, factor) == (stated or (None, None)) and (reason is None) == (stated is not None)


def test_amounts_out_of_range(spark):
    rows = [(1, 1e30, "g"), (2, 1.0, "10^99 mg"), (3, 1.0, " ".join(["10^99"] * 5) + " mg"), (4, 3.0, "mg²"), (5, 0.0, "10^99 mg"), (6, -1e30, "g"), (7, 2.0, "0^2 mg")]
    units = spark.createDataFrame(UNITS, "unit string, dimension string, factor_to_base double")
    records = spark.createDataFrame(rows, "rec_id bigint, amount double, unit string").selectExpr("*", "cast(null as string) AS timeframe")
    out = {r["rec_id"]: r for r in daily_amounts(records, units).collect()}
    assert [out[i]["reason"] for i in (1, 2, 3, 6)] == ["out of range"] * 4 and out[1]["dimension"] is None
    assert out[4]["amount_base"] is None and out[5]["amount_base"] == out[7]["amount_base"] == 0

import pytest

from larder.operators import guidelines

UNITS = [("µg", "mass", 1.0), ("mg", "mass", 1e3), ("g", "mass", 1e6), ("kcal", "energy", 4184.0), ("kJ", "energy", 1000.0), ("ml", "volume", 1e3), ("IU", "activity", 1.0), ("%E", "none", None)]
GROUP = "struct<sex:string,age_min:int,age_max:int,life_stage:string>"


def test_convert(spark):
    rows = [(1, 500.0, "mg", "g"), (2, 1.0, "g", "µg"), (3, 1.0, "kcal", "kJ"), (4, 10.0, "%E", "%E"), (5, 10.0, "%E", "g"), (6, 5.0, "IU", "µg"), (7, 1.0, "g", "ml"), (8, 1.0, None, "g"), (9, None, "g", "mg")]
    units = spark.createDataFrame(UNITS, "unit string, dimension string, factor_to_base double")
    df = spark.createDataFrame(rows, "i int, amount double, unit string, target_unit string")
    got = {r["i"]: (r["converted"], r["error"]) for r in guidelines.convert_amounts(df, units).collect()}
    assert [got[i][0] for i in range(1, 5)] == [0.5, 1e6, 4.184, 10.0] and all(got[i][0] is None and got[i][1] for i in (5, 6, 7, 8)) and got[9] == (None, None)
    with pytest.raises(Exception, match="cannot convert"):
        guidelines.convert_amounts(df, units, strict=True).collect()


def test_daily(spark):
    df = spark.createDataFrame([(14.0, "per_week"), (60.0, "per_month"), (3.0, "per_day"), (1.0, "per_meal"), (1.0, None)], "amount double, timeframe string")
    got = [(r["d"]["amount"], r["d"]["error"] is None) for r in df.select(guidelines.daily("amount", "timeframe").alias("d")).collect()]
    assert got == [(2.0, True), (2.0, True), (3.0, True), (None, False), (None, False)]
    with pytest.raises(Exception, match="no days"):
        df.select(guidelines.daily("amount", "timeframe", strict=True)).collect()


def test_compare(spark):
    schema = f"rec_id bigint, nutrient string, population_group {GROUP}, recommendation_type string"
    adult, young = ("female", 19, 50, "adult"), ("female", 19, None, None)
    extracted = [(1, "iron", None, "target"), (2, "iron", adult, "target"), (3, "iron", young, "range"), (4, "zinc", None, "target")]
    known = [(10, "iron", None, "range"), (11, "iron", young, "range"), (12, "iron", young, "target")]
    got = guidelines.compare(spark.createDataFrame(extracted, schema), spark.createDataFrame(known, schema)).collect()
    assert sorted((r[0], r[1] or 0, r[2]) for r in got) == [(1, 10, "partial"), (2, 0, "no_guideline"), (3, 11, "full"), (3, 12, "partial"), (4, 0, "no_guideline")]
    assert guidelines.compare(spark.createDataFrame([], schema), spark.createDataFrame(known, schema)).count() == 0


def test_types_are_compared_not_records(spark):
    """Two records that differ in everything but type and key are still fully compatible."""
    df = spark.createDataFrame([("target", "adequate_intake"), ("adequate_intake", "target"), ("range", "target"), ("range", "range"), ("odd", "odd"), (None, "target")], "a string, b string")
    assert [r["c"] for r in df.select(guidelines.compatibility("a", "b").alias("c")).collect()] == ["full", "full", "partial", "full", "partial", "partial"]


def test_aliases(spark):
    aliases = spark.createDataFrame([("Iron", "en", "min_iron"), ("Eisen", "de", "min_iron"), ("protein", "en", "mac_protein"), ("Protein", "de", "mac_protein")], "alias string, lang string, nutrient_id string")
    df = spark.createDataFrame([(1, "Eisen"), (2, " EISEN "), (3, "min_iron"), (4, "Gold"), (5, None), (6, "")], "rec_id bigint, nutrient string")
    folded = {r["rec_id"]: r["nutrient_id"] for r in guidelines.canonical_nutrient(df, aliases).collect()}
    exact = {r["rec_id"]: r["nutrient_id"] for r in guidelines.canonical_nutrient(df, aliases, fold=False).collect()}
    assert folded == {1: "min_iron", 2: "min_iron", 3: "min_iron", 4: None, 5: None, 6: None} and exact == {1: "min_iron", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_lists(spark):
    schema = f"rec_id bigint, nutrient string, population_group {GROUP}"
    rows = [(i, "iron", None) for i in range(500)] + [(900, "zinc", ("female", None, None, None)), (901, None, None)]
    got = guidelines.guideline_lists(spark.createDataFrame(rows, schema), 100).collect()
    iron = [r for r in got if r["nutrient"] == "iron"]
    assert len(iron) == 5 and sorted(i for r in iron for i in r["rec_ids"]) == list(range(500)) and max(len(r["rec_ids"]) for r in iron) < 150
    assert [r["rec_ids"] for r in got if r["nutrient"] != "iron"] in ([[900], [901]], [[901], [900]])


def test_both_micro_signs(spark):
    units = spark.createDataFrame(UNITS, "unit string, dimension string, factor_to_base double")
    df = spark.createDataFrame([(1, 1.0, "g", "\u03bcg"), (2, 1.0, "g", "\u00b5g"), (3, 5.0, "\u03bcg", "mg")], "i int, amount double, unit string, target_unit string")
    got = {r["i"]: r["converted"] for r in guidelines.convert_amounts(df, units, strict=True).collect()}
    assert got == {1: 1e6, 2: 1e6, 3: 0.005}

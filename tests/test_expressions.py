"""Scalar expressions, labels and text on hand cases."""

import pytest
from pyspark.sql import functions as F

from harvestlens.functions import agronomy, columns, labels


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_trim_and_rename(spark):
    df = spark.createDataFrame([("  a ", 1, None)], "`Big Name` string, n int, s string")
    row = columns.rename(columns.trim_strings(df), {"Big Name": "name"}).first()
    assert row.asDict() == {"name": "a", "n": 1, "s": None}


@pytest.mark.parametrize("text, width, want", [("7", 3, "007"), ("1234", 3, "1234"), ("", 2, "00"), (None, 2, None)])
def test_zero_pad(spark, text, width, want):
    assert one(spark, "t string", (text,), columns.zero_pad(F.col("t"), width)) == want


def test_casts(spark):
    assert one(spark, "t string", ("x",), columns.tolerant_cast(F.col("t"), "double")) is None
    assert one(spark, "t string", ("NaN",), columns.tolerant_cast(F.col("t"), "double")) is None
    assert one(spark, "t string", ("2012",), columns.strict_cast(F.col("t"), "int")) == 2012
    with pytest.raises(Exception, match="not a int"):
        one(spark, "t string", ("x",), columns.strict_cast(F.col("t"), "int"))


@pytest.mark.parametrize("element, value, keep", [
    ("TMAX", 60.0, True), ("TMAX", 60.1, False), ("TMIN", -60.0, True), ("PRCP", 2000.0, True), ("PRCP", -0.1, False),
    ("AWND", -60.5, False)])
def test_plausible(spark, element, value, keep):
    assert one(spark, "e string, v double", (element, value), agronomy.plausible(F.col("e"), F.col("v"))) is keep


def test_sentinels(spark):
    assert one(spark, "v double", (9999.9,), agronomy.fahrenheit_to_c(F.col("v"))) is None
    assert one(spark, "v double", (50.0,), agronomy.fahrenheit_to_c(F.col("v"))) == pytest.approx(10.0)
    assert one(spark, "v double", (99.99,), agronomy.inches_to_mm(F.col("v"))) == 0.0
    assert one(spark, "v double", (None,), agronomy.inches_to_mm(F.col("v"))) == 0.0
    assert one(spark, "v double", (999.9,), agronomy.knots_to_ms(F.col("v"))) is None
    assert one(spark, "v double", (-999.0,), agronomy.sentinel_to_null(F.col("v"))) is None


def test_clip_round_dates(spark):
    assert one(spark, "v double", (None,), columns.clip_lower(F.col("v"), 1)) is None
    assert one(spark, "v double", (0.2,), columns.clip_lower(F.col("v"), 1)) == 1.0
    assert one(spark, "v double", (0.1 + 0.2 + 0.05,), columns.round_to(F.col("v"), 1)) == 0.4
    assert str(one(spark, "t string", ("20240229",), columns.parse_date(F.col("t")))) == "2024-02-29"
    assert one(spark, "t string", ("20240230",), columns.parse_date(F.col("t"))) is None
    assert one(spark, "t string", (" ",), columns.blank(F.col("t"))) is True


def test_indices(spark):
    row = spark.createDataFrame([(30.0, 16.0, 23.0, 500.0)], "a double, b double, c double, p double").select(
        agronomy.et0_estimate(F.col("a"), F.col("b"), F.col("c")).alias("et0")).first()
    assert row["et0"] == pytest.approx(2254.1720, abs=1e-3)
    assert one(spark, "e double, p double", (2254.1720, 500.0), agronomy.water_stress(F.col("e"), F.col("p"))) == 4.508


@pytest.mark.parametrize("z, want", [(-1.5, "NORMAL"), (-1.51, "LOW"), (1.51, "HIGH"), (None, "NORMAL")])
def test_direction(spark, z, want):
    assert one(spark, "z double", (z,), labels.direction(F.col("z"))) == want


@pytest.mark.parametrize("flags, want", [
    ((True, True, False), "UNEXPLAINED"), ((True, False, False), "WEATHER_DRIVEN"), ((False, True, False), "RESIDUAL_ONLY"),
    ((False, False, True), "ISOLATION_ONLY"), ((False, False, False), "NORMAL"), ((True, False, True), "WEATHER_DRIVEN"),
    ((None, None, True), "ISOLATION_ONLY")])
def test_anomaly_type(spark, flags, want):
    expr = labels.anomaly_type(F.col("z"), F.col("r"), F.col("i"))
    assert one(spark, "z boolean, r boolean, i boolean", flags, expr) == want


def test_weather_context(spark):
    schema = ("commodity_name string, year int, precip_z double, precip_total_mm double, heat_stress_days double, "
              "gdd_base10 double, cwsi double")
    df = spark.createDataFrame([("Corn", 2012, -2.0, 210.4, 25.0, 1100.0, 2.5), ("Soybeans", 2011, 0.0, 9.0, 1.0, 950.0, None)], schema)
    texts = [r.t for r in df.select(labels.weather_context(df).alias("t")).collect()]
    assert texts[0] == ("drought (precip 210 mm, Z=-2.0); heat stress (25 days >35°C); low GDD (1100); "
                        "water stress (CWSI=2.5); Great Plains Drought")
    assert texts[1] == labels.NO_SIGNAL


def test_explanations(spark):
    df = spark.createDataFrame([([("heat_days", -4.25), ("rain", 2.0), ("x", 1.0), ("y", 0.5)], -12.34, -1.7, -2.0)],
                               "d array<struct<feature:string,value:double>>, g double, gz double, z double")
    row = df.select(labels.driver_sentence(F.col("d")).alias("a"), labels.residual_sentence(F.col("g"), F.col("gz")).alias("b")).first()
    assert row.a == ("heat days decreased predicted yield by 4.3 bu/ac; rain increased predicted yield by 2.0 bu/ac; "
                     "x increased predicted yield by 1.0 bu/ac")
    assert row.b.startswith("After weather effects, actual yield was 12.3 bu/ac below") and "significant" in row.b
    full = df.select(labels.full_explanation(F.col("z"), F.lit(""), F.lit(""), F.lit("ctx")).alias("t")).first().t
    assert full == "Unexpectedly LOW yield (Z=-2.00) | Weather context: ctx"


def test_active_features(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (None, None, None)], "a double, b double, c double")
    assert columns.active_features(df, ["a", "b", "c", "zz"]) == ["a"]

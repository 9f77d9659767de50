"""Index, risk and explanation expressions."""

import pytest
from pyspark.sql import functions as F

from smogline.functions import aqi, risk
from smogline.operators import explain, indices, profile


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_categories_of_concentrations(spark):
    got = column(spark, [15.0, 45.0, 75.0, 110.0, 200.0, 350.0, -5.0, float("nan"), None], aqi.pm25_category)
    assert got == ["Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe", "Unknown", "Unknown", "Unknown"]


def test_bracket_edges_and_gaps(spark):
    assert column(spark, [0.0, 30.0, 60.0, 90.0, 500.0, 700.0], lambda x: aqi.subindex(x, "pm25")) == pytest.approx([0, 50, 100, 200, 500, 500])
    assert column(spark, [30.05], lambda x: aqi.subindex(x, "pm25")) == [51.0]
    assert column(spark, [30.05], lambda x: aqi.subindex(x, "pm25", gap="reference")) == [0.0]
    assert column(spark, [30.5], lambda x: aqi.subindex(x, "pm25", "station", "reference")) == [500.0]


def test_the_two_category_variants_differ_between_brackets(spark):
    assert column(spark, [50.3], aqi.category) == ["Good"]
    assert column(spark, [50.3], lambda x: aqi.category(x, rounding=False)) == ["Satisfactory"]


def test_overall_takes_the_largest_and_the_first_on_ties(spark):
    df = spark.createDataFrame([(45.0, 40.0, None), (30.0, 50.0, 40.0), (None, None, None)], "pm25 double, pm10 double, no2 double")
    rows = indices.with_overall(df).collect()
    assert [r["dominant_pollutant"] for r in rows] == ["PM25", "PM25", None]
    assert rows[1]["aqi"] == 50.0 and rows[2]["category"] == "Unknown"
    official = indices.with_overall(df, min_pollutants=3).collect()
    assert [r["aqi"] is None for r in official] == [True, False, True]


def test_missing_satellite_widens_the_interval(spark):
    df = spark.createDataFrame([(80.0, 5.0, False, 800.0), (80.0, 5.0, True, 800.0), (80.0, 5.0, False, 300.0)],
                               "y double, d double, miss boolean, pblh double")
    got = [r[0] for r in df.select(risk.prediction_interval(F.col("y"), F.col("d"), F.col("miss"), F.col("pblh"))).collect()]
    assert got[0]["margin_of_error"] == pytest.approx(23.6)
    assert got[1]["margin_of_error"] > got[2]["margin_of_error"] > got[0]["margin_of_error"]
    assert all(r["pm25_lower_bound"] >= 0 for r in got)


def test_reliability_levels(spark):
    df = spark.createDataFrame([(1.0, False, False), (15.0, True, False), (40.0, True, True)], "d double, a boolean, n boolean")
    got = [r[0] for r in df.select(risk.reliability(F.col("d"), F.col("a"), F.col("n"), F.lit(0.15))).collect()]
    assert [r["reliability_level"] for r in got] == ["HIGH", "LOW", "LOW"]
    assert got[2]["reliability_score"] == 35


def test_prediction_id_is_stable(spark):
    df = spark.createDataFrame([(18.5, 73.8, "2024-01-01")], "a double, b double, t string")
    made = [df.select(risk.prediction_id(F.col("a"), F.col("b"), F.col("t"), F.lit("v1"))).first()[0] for _ in range(2)]
    assert made[0] == made[1] and made[0].startswith("PRED-") and len(made[0]) == 17


def test_best_horizons(spark):
    df = spark.createDataFrame([("a", 1, 80.0, "Moderate"), ("a", 6, 42.0, "Satisfactory"), ("a", 12, 110.0, "Poor"), ("a", 24, 42.0, "Satisfactory")],
                               "place string, horizon_hours int, predicted_pm25 double, category string")
    row = profile.best_horizon_window(df, ["place"]).first()
    assert (row["lowest_predicted_pm25"], row["peak_hazard_pm25"], row["peak_hazard_horizon"]) == (42.0, 110.0, "+12h")
    assert row["recommended_window"] == "In +6 hour(s) (Satisfactory air quality)"


def test_narrative_and_top_contributions(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (2, 0.0, 30.0)], "id int, aod_550nm double, temperature_2m double")
    made = explain.contributions_array(df, {"aod_550nm": 30.0, "temperature_2m": -1.0}, 5.0)
    rows = made.select("id", explain.topk(F.col("contributions"), 1).alias("c"),
                       risk.narrative(F.lit(75.0), F.col("base_value"), F.col("contributions")).alias("n")).orderBy("id").collect()
    assert rows[0]["c"][0]["feature"] == "aod_550nm" and rows[0]["c"][0]["contribution"] == pytest.approx(30.0)
    text = rows[0]["n"].splitlines()
    assert text[0] == "Estimated PM2.5: 75.0 ug/m3, class MODERATE."
    assert text[3] == "- Haze seen from orbit: +30.0 ug/m3"

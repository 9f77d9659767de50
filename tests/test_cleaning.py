"""Cleaners, units and keys on literal rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from smogline import constants as K
from smogline.functions import clock, meteo
from smogline.operators import cleaning, features, imputing, matching, quality


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_ground_bounds_blank_sentinels(spark):
    df = spark.createDataFrame([("A", 45.0), ("A", -999.0), ("A", 1500.0)], "station_id string, pm25 double")
    assert values(cleaning.mask_physical_bounds(df), "pm25") == [45.0, None, None]


def test_aod_quality_and_range(spark):
    df = spark.createDataFrame([(0.4, 3), (0.5, 1), (6.5, 3), (-0.1, 2), (None, 3)], "aod_550nm double, aod_qa_flag int")
    out = cleaning.clean_aod(df)
    assert values(out, "aod_550nm") == [0.4, None, None, None, None]
    assert values(out, "is_aod_missing") == [0, 1, 1, 1, 1]
    low_is_good = cleaning.clean_aod(df, min_qa=1, high_is_good=False)
    assert values(low_is_good, "aod_550nm")[1] == 0.5


def test_weather_units(spark):
    df = spark.createDataFrame([(300.15, 290.15, 3.0, 4.0, 20.0, 101325.0, -0.1)],
                               "temperature_2m double, dewpoint_temperature_2m double, u_component_of_wind_10m double, "
                               "v_component_of_wind_10m double, boundary_layer_height double, surface_pressure double, total_precipitation double")
    row = cleaning.clean_weather(df).first()
    assert row["temperature_2m"] == pytest.approx(27.0)
    assert row["wind_speed_10m"] == pytest.approx(5.0)
    assert row["boundary_layer_height"] == 50.0
    assert row["surface_pressure"] == pytest.approx(1013.25)
    assert row["precipitation_1h"] == 0.0
    assert 0 < row["relative_humidity_2m"] < 100


def test_wind_direction_is_where_it_comes_from(spark):
    df = spark.createDataFrame([(0.0, -1.0), (-1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], "u double, v double")
    got = values(df.select(meteo.wind_from(F.col("u"), F.col("v")).alias("d")), "d")
    assert got == pytest.approx([0.0, 90.0, 180.0, 180.0])


def test_half_hours_go_to_the_even_hour(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 30),), (datetime(2024, 1, 1, 13, 30),), (datetime(2024, 1, 1, 9, 31),)],
                               "ts timestamp_ntz")
    got = values(df.select(clock.round_to_hour(F.col("ts")).alias("h")), "h")
    assert [g.hour for g in got] == [10, 14, 10]


def test_missing_policy_keeps_two_of_three(spark):
    df = spark.createDataFrame([(50.0, 0.4, 25.0, 5.0), (None, 0.3, 26.0, 4.0), (70.0, None, None, None)],
                               "aqi_label double, aod_550nm double, temperature_2m double, road_density double")
    rows = imputing.impute_policy(df).collect()
    assert len(rows) == 2
    gap = next(r for r in rows if r["aqi_label"] == 70.0)
    assert gap["aod_550nm"] is None and gap["is_aod_missing"] == 1
    assert gap["temperature_2m"] == 25.0 and gap["road_density"] == 0.0


def test_median_fallbacks_without_any_value(spark):
    df = spark.createDataFrame([(1.0, None, None)], "pm25_ground double, boundary_layer_height double, elevation_m double")
    row = imputing.impute_policy(df).first()
    assert (row["boundary_layer_height"], row["elevation_m"]) == (500.0, 200.0)


def test_alias_copy_and_rename(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["PM2.5", "no2"])
    assert cleaning.alias_harmonise(df, cleaning.GROUND_ALIASES, copy=True).columns == ["PM2.5", "no2", "pm25"]
    assert cleaning.alias_harmonise(df, {"PM2.5": "no2"}).columns == ["PM2.5", "no2"]


def test_pivot_drops_rows_without_key_or_value(spark):
    df = spark.createDataFrame([("A", "t", "PM2.5", 10.0), ("A", "t", "pm25", 20.0), ("A", "t", "xyz", 1.0), (None, "t", "no2", 3.0),
                                ("B", "t", "no2", None)], "station_id string, timestamp_utc string, parameter string, value double")
    rows = cleaning.pivot_long_to_wide(df).collect()
    assert [(r["station_id"], r["pm25"], r["no2"]) for r in rows] == [("A", 15.0, None)]


def test_leakage_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], ["pm25_ground", "aqi_label", "temperature_2m"])
    assert features.drop_leakage(df).columns == ["pm25_ground", "temperature_2m"]
    with pytest.raises(ValueError):
        features.drop_leakage(df.drop("pm25_ground"))


def test_quality_rules_name_what_is_wrong(spark):
    row = {c: 1.0 for c in K.REQUIRED_COLUMNS} | {"latitude": 18.5, "longitude": 73.8, "timestamp_utc": "2024-01-01 00:00:00",
                                                  "location_id": "x", "station_id": "s", "boundary_layer_height": 500.0, "surface_pressure": 950.0}
    names = list(row)
    good = spark.createDataFrame([tuple(row.values())], names)
    passed = {r["rule"]: r["passed"] for r in quality.quality_rules(good, min_rows=1).collect()}
    assert all(passed.values()), passed
    bad_row = row | {"latitude": 30.0, "pm25_ground": 2000.0, "temporal_offset_minutes": 120.0}
    bad = spark.createDataFrame([tuple(row.values()), tuple(bad_row.values()), tuple(bad_row.values())], names)
    failed = {r["rule"]: r["bad_rows"] for r in quality.quality_rules(bad, min_rows=1).collect() if not r["passed"]}
    assert failed == {"latitude_bounds": 2, "pm25_ground_bounds": 2, "temporal_offset": 2, "duplicates": 1}


def test_blank_search_returns_everything(spark):
    df = spark.createDataFrame([("Alpha", "पुणे"), ("Beta", "नाशिक")], ["name", "name_mr"])
    assert matching.location_search(df, "  ", ["name"]).count() == 2
    assert values(matching.location_search(df, "ALP", ["name", "name_mr"]), "name") == ["Alpha"]
    assert values(matching.location_search(df, "नाशिक", ["name", "name_mr"]), "name") == ["Beta"]

"""Filling missing values from fitted statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from smogline import constants as K
from smogline.operators.cleaning import missing_flags
from smogline.operators.common import null_safe_join, present, with_row_of
from smogline.operators.quantiles import exact_quantiles

MEDIAN_FILLED = ["temperature_2m", "temperature", "relative_humidity_2m", "humidity",
                 "wind_speed_10m", "wind_speed", "boundary_layer_height", "elevation_m"]
# What a median column falls back to when it holds no value at all.
FALLBACK = {"boundary_layer_height": 500.0, "elevation_m": 200.0}
CONSTANT_FILLED = {"wind_direction_10m": 180.0, "wind_direction": 180.0,
                   "road_density": 0.0, "building_density": 0.0, "precipitation_1h": 0.0}


def fit_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of medians, named like the columns."""
    names = present(df, columns)
    return exact_quantiles(df, [], names, [0.5]).select(*[F.col(f"{c}_p50").alias(c) for c in names])


def impute_policy(df: DataFrame, training: bool = True, targets=("aqi_label", "ground_pm25", "pm25_ground"),
                  weather: bool = True, satellite: bool = False, static: bool = True,
                  medians: DataFrame | None = None) -> DataFrame:
    """Flag what is missing, drop untargeted training rows, fill weather and geography.

    Medians are fitted on the (filtered) input unless a fitted row is passed in.
    """
    out = missing_flags(df)
    if training:
        for t in present(out, targets):
            out = out.filter(F.col(t).isNotNull())
    median_names = [c for c in MEDIAN_FILLED if c in out.columns
                    and ((c == "elevation_m" and static) or (c != "elevation_m" and weather))]
    if satellite:
        median_names += present(out, K.FLAGGED_SATELLITE)
    constants = {c: v for c, v in CONSTANT_FILLED.items() if c in out.columns
                 and (weather if c.startswith("wind") else static)}
    if median_names:
        out = with_row_of(out, medians if medians is not None else fit_medians(out, median_names), "_m")
    fills = {c: F.coalesce(F.col(c), F.col("_m")[c], F.lit(FALLBACK.get(c))) for c in median_names}
    fills |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()}
    return out.withColumns(fills).drop("_m")


def climatology_impute(df: DataFrame, columns: list[str], ts="timestamp_utc",
                       keys=("lat_cell", "lon_cell")) -> DataFrame:
    """Fill missing values with their cell's median for the calendar month."""
    by = [*keys, "_month"]
    dated = df.withColumn("_month", F.month(ts))
    normal = exact_quantiles(dated, by, columns, [0.5])
    joined = null_safe_join(dated, normal, by, "left")
    return (joined.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_p50")) for c in columns})
            .drop("_month", *[f"{c}_p50" for c in columns]))

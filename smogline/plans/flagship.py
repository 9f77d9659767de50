"""Raw readings to the worst station-hours: gate, pivot, bounds, flatline mask, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from smogline import constants as K
from smogline.functions import clock
from smogline.operators import cleaning, indices, series
from smogline.plans import sqltext as S
from smogline.plans.registry import query

OBSERVED = ["pm25", "no2", "so2", "co", "o3"]


def hourly_index(long: DataFrame, flat_run: int = 4) -> DataFrame:
    """Station-hours with cleaned pollutants, overall index, dominant pollutant and category."""
    hourly = long.withColumn("timestamp_utc", clock.trunc_hour(F.col("timestamp_utc")))
    wide = cleaning.pivot_long_to_wide(hourly, ["station_id", "timestamp_utc"])
    bounded = cleaning.mask_physical_bounds(wide)
    masked = series.flatline_mask(bounded, OBSERVED, run=flat_run)
    return indices.with_overall(masked, K.POLLUTANTS).drop("color", "health_advisory", "n_pollutants")


_MEANS = ", ".join(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in OBSERVED)
_BOUNDS = ", ".join(f"CASE WHEN {p} BETWEEN {K.POLLUTANT_LIMITS[p][0]} AND {K.POLLUTANT_LIMITS[p][1]} THEN {p} END AS {p}"
                    for p in OBSERVED)
_FLAT = ", ".join(f"CASE WHEN {p} = lag({p}, 1) OVER w AND {p} = lag({p}, 2) OVER w AND {p} = lag({p}, 3) OVER w "
                  f"THEN NULL ELSE {p} END AS {p}" for p in OBSERVED)

@query("worst_station_hours", "pm25 no2 so2 co o3 aqi", f"""
    WITH h AS (SELECT station_id, date_trunc('hour', timestamp_utc) AS timestamp_utc, {_MEANS} FROM v_obs_long
               WHERE value IS NOT NULL GROUP BY ALL),
         b AS (SELECT station_id, timestamp_utc, {_BOUNDS} FROM h),
         f AS (SELECT station_id, timestamp_utc, {_FLAT} FROM b
               WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc)),
         i AS ({S.with_index(OBSERVED, 'f')})
    SELECT *, {S.category('aqi')} AS category FROM i ORDER BY aqi DESC, station_id, timestamp_utc""")
def _worst(t):
    return (hourly_index(t.v_obs_long).drop("pm10")
            .orderBy(F.col("aqi").desc_nulls_last(), "station_id", "timestamp_utc"))

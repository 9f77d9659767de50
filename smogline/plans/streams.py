"""Queries of the streaming jobs, run over the event files until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline.plans import sqltext as S
from smogline.plans.flagship import OBSERVED
from smogline.plans.registry import query
from smogline.session import work_folder
from smogline.streaming import hourly


def _readings(t):
    """The events file as a stream of long readings."""
    raw = hourly.read_files(t.spark, t.folder, "events.parquet", t.events.schema)
    name = (F.when(F.col("event_type") == "error", "pm25").when(F.col("event_type") == "click", "no2")
            .when(F.col("event_type") == "view", "so2").when(F.col("event_type") == "signup", "co").otherwise("o3"))
    value = (F.when(F.col("event_id") % 97 == 0, -999.0).when(F.col("event_id") % 101 == 0, 5000.0)
             .when(F.col("event_type") == "signup", F.col("value") / 10).otherwise(F.col("value")))
    return raw.select(F.col("event_id").alias("record_id"), (F.col("user_id") % 10).alias("station_id"),
                      F.col("ts").alias("timestamp_utc"), name.alias("parameter"), value.alias("value"))


_VALID = " OR ".join(f"(parameter = '{p}' AND value BETWEEN {lo} AND {hi})" for p, (lo, hi) in
                     ((p, hourly.K.POLLUTANT_LIMITS[p]) for p in OBSERVED))


@query("stream_hourly_aqi", " ".join(OBSERVED) + " aqi", f"""
    WITH x AS (SELECT * FROM v_obs_long WHERE {_VALID}),
         h AS (SELECT date_trunc('hour', timestamp_utc) AS hour, station_id, count(*) AS readings,
                      {', '.join(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in OBSERVED)} FROM x GROUP BY ALL),
         closed AS (SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(timestamp_utc) FROM x) - INTERVAL 2 HOUR)
    SELECT *, {S.category('aqi')} AS category FROM ({S.with_index(OBSERVED, 'closed')})""")
def _hourly(t):
    folder = work_folder(t.spark, "hourly")
    hourly.run_hourly(_readings(t), f"{folder}/out", f"{folder}/state", pollutants=OBSERVED)
    return t.spark.read.parquet(f"{folder}/out")


@query("stream_freshness", "age_minutes", """
    WITH l AS (SELECT station_id, max(timestamp_utc) AS last_seen FROM v_obs_long GROUP BY 1),
         a AS (SELECT *, (epoch_us((SELECT max(timestamp_utc) FROM v_obs_long)) - epoch_us(last_seen)) / 60e6 AS age_minutes FROM l)
    SELECT station_id, last_seen, age_minutes, age_minutes > 30 AS is_stale FROM a""")
def _freshness(t):
    folder = work_folder(t.spark, "freshness")
    hourly.run_freshness(_readings(t), f"{folder}/out", f"{folder}/state")
    updates = t.spark.read.parquet(f"{folder}/out")
    return hourly.freshness_table(updates, updates.agg(F.max("last_seen").alias("t")), 30.0)

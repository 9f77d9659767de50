"""Queries of ordered series operators and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.operators import series
from smogline.plans.registry import query

_W = "(PARTITION BY station_id ORDER BY timestamp_utc, event_id)"


@query("flatline_mask", "pm25", f"""
    SELECT event_id, station_id, timestamp_utc,
           CASE WHEN pm25 = lag(pm25, 1) OVER w AND pm25 = lag(pm25, 2) OVER w AND pm25 = lag(pm25, 3) OVER w THEN NULL ELSE pm25 END AS pm25
    FROM v_obs_flat WINDOW w AS {_W}""")
def _flat(t):
    return series.flatline_mask(t.v_obs_flat, ["pm25"], tie=["event_id"])


@query("stuck_drop", "pm25", f"""
    SELECT event_id, station_id, timestamp_utc, pm25 FROM v_obs_flat WHERE pm25 BETWEEN 0 AND 1000
    WINDOW w AS {_W} QUALIFY NOT coalesce({' AND '.join(f'pm25 = lag(pm25, {k}) OVER w' for k in range(1, 6))}, false)""")
def _stuck(t):
    return series.stuck_drop(t.v_obs_flat, "pm25", tie=["event_id"])


_LAGS = series.lag_columns()
_LEADS = [f"target_lead_{h}h" for h in K.HORIZON_HOURS]
_LAG_SQL = ", ".join([f"lag(pm25_ground, {k}) OVER w AS {n}" for k, n in zip(K.LAG_HOURS, _LAGS)]
                     + [f"lead(pm25_ground, {h}) OVER w AS {n}" for h, n in zip(K.HORIZON_HOURS, _LEADS)])


@query("lag_lead_features", "pm25_ground " + " ".join(_LAGS + _LEADS), f"SELECT *, {_LAG_SQL} FROM v_pm25 WINDOW w AS {_W}")
def _lags(t):
    return series.lag_lead_features(t.v_pm25, tie=["event_id"])


@query("lag_lead_exact", "pm25 lag_1h lag_24h lead_6h", """
    SELECT a.station_id, a.timestamp_utc, a.pm25, b.pm25 AS lag_1h, c.pm25 AS lag_24h, d.pm25 AS lead_6h FROM v_obs_hourly a
    LEFT JOIN v_obs_hourly b ON a.station_id = b.station_id AND b.timestamp_utc = a.timestamp_utc - INTERVAL 1 HOUR
    LEFT JOIN v_obs_hourly c ON a.station_id = c.station_id AND c.timestamp_utc = a.timestamp_utc - INTERVAL 24 HOUR
    LEFT JOIN v_obs_hourly d ON a.station_id = d.station_id AND d.timestamp_utc = a.timestamp_utc + INTERVAL 6 HOUR""")
def _lags_exact(t):
    out = series.lag_lead_exact(t.v_obs_hourly.select("station_id", "timestamp_utc", "pm25"), "pm25", lags=[1, 24], horizons=[6])
    return out.withColumnsRenamed({"pm25_lag_1h": "lag_1h", "pm25_lag_24h": "lag_24h", "target_lead_6h": "lead_6h"})


_ROLL = ["pm25_ground_rolling_mean_6h", "pm25_ground_rolling_mean_24h", "pm25_ground_rolling_std_24h",
         "pm25_ground_rolling_max_24h", "pm25_ground_rolling_min_24h"]
_ROLL_SQL = """avg(pm25_ground) OVER s AS pm25_ground_rolling_mean_6h, avg(pm25_ground) OVER d AS pm25_ground_rolling_mean_24h,
    coalesce(stddev_samp(pm25_ground) OVER d, 0) AS pm25_ground_rolling_std_24h,
    max(pm25_ground) OVER d AS pm25_ground_rolling_max_24h, min(pm25_ground) OVER d AS pm25_ground_rolling_min_24h"""
_FRAMES = ("s AS (PARTITION BY station_id ORDER BY timestamp_utc, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), "
           "d AS (PARTITION BY station_id ORDER BY timestamp_utc, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")


@query("rolling_stats", "pm25_ground " + " ".join(_ROLL), f"SELECT *, {_ROLL_SQL} FROM v_pm25 WINDOW {_FRAMES}")
def _rolling(t):
    return series.lag_lead_features(t.v_pm25, tie=["event_id"], lags=[], horizons=[], rolling=True, extremes=True)


_BFILL = ", ".join(
    f"coalesce(first_value({n} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp_utc, event_id ROWS BETWEEN CURRENT ROW "
    f"AND UNBOUNDED FOLLOWING), (SELECT median(pm25_ground) FROM x)) AS {n}" for n in _LAGS)
# every eleventh reading is unknown here, so that lags have gaps inside the series
_GAPPED = "SELECT event_id, station_id, timestamp_utc, CASE WHEN event_id % 11 <> 0 THEN pm25_ground END AS pm25_ground FROM v_pm25"


@query("lag_impute", "pm25_ground " + " ".join(_LAGS + _LEADS), f"""
    WITH x AS ({_GAPPED}), l AS (SELECT *, {_LAG_SQL} FROM x WINDOW w AS {_W})
    SELECT * FROM (SELECT * REPLACE ({_BFILL}) FROM l) WHERE target_lead_1h IS NOT NULL""")
def _impute(t):
    gapped = t.v_pm25.withColumn("pm25_ground", F.when(F.col("event_id") % 11 != 0, F.col("pm25_ground")))
    return series.lag_impute(series.lag_lead_features(gapped, tie=["event_id"]), tie=["event_id"])


@query("gap_interpolate", "pm25_ground", f"""
    WITH x AS ({_GAPPED}), n AS (
      SELECT *, epoch_us(timestamp_utc) / 1e6 AS t,
        last_value(CASE WHEN pm25_ground IS NOT NULL THEN epoch_us(timestamp_utc) / 1e6 END IGNORE NULLS) OVER b AS t0,
        last_value(pm25_ground IGNORE NULLS) OVER b AS v0,
        first_value(CASE WHEN pm25_ground IS NOT NULL THEN epoch_us(timestamp_utc) / 1e6 END IGNORE NULLS) OVER f AS t1,
        first_value(pm25_ground IGNORE NULLS) OVER f AS v1 FROM x
      WINDOW b AS (PARTITION BY station_id ORDER BY timestamp_utc, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY station_id ORDER BY timestamp_utc, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, station_id, timestamp_utc,
           coalesce(pm25_ground, CASE WHEN t1 - t0 <= 43200 THEN v0 + (v1 - v0) * ((t - t0) / nullif(t1 - t0, 0)) END) AS pm25_ground FROM n""")
def _gaps(t):
    gapped = t.v_pm25.withColumn("pm25_ground", F.when(F.col("event_id") % 11 != 0, F.col("pm25_ground")))
    return series.gap_interpolate(gapped, "pm25_ground", tie=["event_id"], max_gap_hours=12.0)

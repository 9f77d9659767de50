"""Queries of exploratory aggregates and model scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.functions import aqi, clock
from smogline.operators import cleaning, matching, profile, series
from smogline.plans import sqltext as S
from smogline.plans.registry import query


@query("pivot_long_to_wide", "pm25 no2 so2 co o3", """
    SELECT station_id, timestamp_utc, pm25, no2, so2, co, o3 FROM (
      SELECT station_id, date_trunc('hour', timestamp_utc) AS timestamp_utc,
             avg(CASE WHEN parameter = 'pm25' THEN value END) AS pm25, avg(CASE WHEN parameter = 'no2' THEN value END) AS no2,
             avg(CASE WHEN parameter = 'so2' THEN value END) AS so2, avg(CASE WHEN parameter = 'co' THEN value END) AS co,
             avg(CASE WHEN parameter = 'o3' THEN value END) AS o3
      FROM v_obs_long GROUP BY ALL)""")
def _pivot(t):
    spelled = t.v_obs_long.withColumns({
        "timestamp_utc": clock.trunc_hour(F.col("timestamp_utc")),
        "parameter": F.when((F.col("parameter") == "pm25") & (F.col("event_id") % 2 == 0), "PM2.5").otherwise(F.col("parameter"))})
    return cleaning.pivot_long_to_wide(spelled, ["station_id", "timestamp_utc"]).drop("pm10")


@query("daily_mean_complete", "pm25_ground", f"""
    SELECT date, measurements, {S.bround('m', 2)} AS pm25_ground FROM (
      SELECT strftime({S.local('timestamp_utc')}, '%Y-%m-%d') AS date, avg(pm25_ground) AS m, count(*) AS measurements
      FROM v_pm25 GROUP BY 1 HAVING count(*) >= 12)""")
def _daily(t):
    return profile.daily_mean_complete(t.v_pm25, "pm25_ground").withColumn("date", F.col("date").cast("string"))


_STAT = ["pm25_ground", "aod_550nm", "temperature_2m", "satellite_no2"]


@query("summary_stats", "mean std min p25 p50 p75 max", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
           quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM v_features"""
                                                                       for c in _STAT))
def _summary(t):
    return profile.summary_stats(t.v_features, _STAT)


_MISS = {"pm25_ground": "leave out of training", "aod_550nm": "add a gap flag", "satellite_no2": "add a gap flag", "temperature_2m": "fill short gaps in time",
         "boundary_layer_height": "fill short gaps in time", "road_density": "constant or median", "elevation_m": "constant or median", "station_id": "look at it first"}


@query("missingness_profile", "missing_pct", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", n AS missing_count, {S.bround('p', 2)} AS missing_pct, '{_MISS[c]}' AS strategy
    FROM (SELECT count(*) - count({c}) AS n, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS p FROM v_features)""" for c in _MISS))
def _missing(t):
    return profile.missingness_profile(t.v_features.select(*_MISS))


@query("missing_by_group", "aod_550nm_missing_pct temperature_2m_missing_pct", """
    SELECT CAST(month(timestamp_utc) AS INT) AS month, city_key, count(*) AS rows,
           avg(CASE WHEN aod_550nm IS NULL THEN 1.0 ELSE 0 END) * 100 AS aod_550nm_missing_pct,
           avg(CASE WHEN temperature_2m IS NULL THEN 1.0 ELSE 0 END) * 100 AS temperature_2m_missing_pct
    FROM v_features GROUP BY ALL""")
def _missing_group(t):
    return profile.missing_by_group(t.v_features.withColumn("month", F.month("timestamp_utc")), ["aod_550nm", "temperature_2m"],
                                    ["month", "city_key"])


_SEASON = ("CASE WHEN month(timestamp_utc) IN (12, 1, 2) THEN 'Winter' WHEN month(timestamp_utc) IN (3, 4, 5) THEN 'Spring' "
           "WHEN month(timestamp_utc) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END")


@query("group_median", "median ratio", f"""
    WITH m AS (SELECT {_SEASON} AS season, median(pm25_ground) AS median FROM v_features GROUP BY 1)
    SELECT season, median, (SELECT max(median) FROM m) / greatest((SELECT min(median) FROM m), 0.1) AS ratio,
           median = (SELECT max(median) FROM m) AS is_highest, median = (SELECT min(median) FROM m) AS is_lowest FROM m""")
def _group_median(t):
    return profile.group_median(t.v_features.withColumn("season", clock.season(F.month("timestamp_utc"))), "season", "pm25_ground")


@query("landuse_median", "median ratio", """
    WITH m AS (SELECT land_use_class, median(road_density) AS median FROM v_static WHERE land_use_class IS NOT NULL GROUP BY 1)
    SELECT land_use_class, median, (SELECT max(median) FROM m) / greatest((SELECT min(median) FROM m), 0.1) AS ratio,
           median = (SELECT max(median) FROM m) AS is_highest, median = (SELECT min(median) FROM m) AS is_lowest FROM m""")
def _landuse_median(t):
    return profile.group_median(t.v_static, "land_use_class", "road_density")


@query("station_median_map", "latitude longitude median color_cap", """
    WITH m AS (SELECT latitude, longitude, median(pm25) AS median FROM v_ground_located GROUP BY ALL)
    SELECT *, (SELECT quantile_cont(median, 0.95) FROM m) AS color_cap FROM m""")
def _map(t):
    return profile.station_median_map(t.v_ground_located, "pm25")


@query("hourly_profile", "mean std lower upper", """
    WITH h AS (SELECT CAST(hour(timestamp_utc) AS INT) AS hour, avg(pm25_ground) AS mean, stddev_samp(pm25_ground) AS std FROM v_pm25 GROUP BY 1)
    SELECT *, mean - std AS lower, mean + std AS upper, hour = (SELECT hour FROM h ORDER BY mean DESC, hour LIMIT 1) AS is_peak FROM h""")
def _hourly(t):
    return profile.hourly_profile(t.v_pm25, "pm25_ground")


_BINS = " ".join(f"WHEN wind_speed_10m <= {e} THEN {i}" for i, e in enumerate(profile.WIND_BINS[1:]))


@query("binned_median", "median", f"""
    SELECT bin, median(pm25_ground) AS median FROM (SELECT pm25_ground, CASE WHEN wind_speed_10m <= 0 THEN NULL {_BINS} END AS bin FROM v_features)
    WHERE bin IS NOT NULL GROUP BY 1""")
def _binned(t):
    return profile.binned_median(t.v_features, "wind_speed_10m", "pm25_ground")


@query("quartile_median", "median", """
    WITH p AS (SELECT boundary_layer_height AS x, pm25_ground AS y FROM v_features WHERE boundary_layer_height IS NOT NULL AND pm25_ground IS NOT NULL),
         e AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM p)
    SELECT CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 WHEN x <= c THEN 3 ELSE 4 END AS quartile, median(y) AS median FROM p, e GROUP BY 1""")
def _quartile(t):
    return profile.quartile_median(t.v_features, "boundary_layer_height", "pm25_ground")


_XS = ["aod_550nm", "satellite_no2", "temperature_2m", "road_density"]


@query("pair_correlation_ols", "r slope intercept", " UNION ALL ".join(f"""
    SELECT '{x}' AS feature, r, slope, intercept, n, CASE WHEN abs(r) > 0.6 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength
    FROM (SELECT corr({x}, pm25_ground) AS r, regr_slope(pm25_ground, {x}) AS slope, regr_intercept(pm25_ground, {x}) AS intercept,
                 regr_count(pm25_ground, {x})::BIGINT AS n FROM v_features)""" for x in _XS))
def _pairs(t):
    return profile.pair_correlation_ols(t.v_features, _XS, "pm25_ground")


_CORR = ["pm25_ground", "aod_550nm", "satellite_no2", "temperature_2m", "wind_speed_10m", "road_density"]


@query("correlation_matrix", "r", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM v_features" for a, b in combinations(_CORR, 2)) + """)
    SELECT *, CASE WHEN a = 'pm25_ground' OR b = 'pm25_ground'
                   THEN CAST(row_number() OVER (PARTITION BY a = 'pm25_ground' OR b = 'pm25_ground' ORDER BY abs(r) DESC NULLS LAST, a, b) AS INT) END AS target_rank
    FROM c""")
def _matrix(t):
    return profile.correlation_matrix(t.v_features, _CORR, "pm25_ground")


@query("distribution_stats", "mean median skewness above_pct", """
    SELECT count(pm25_ground) AS n, avg(pm25_ground) AS mean, median(pm25_ground) AS median, skewness(pm25_ground) AS skewness,
           avg(CASE WHEN pm25_ground > 60 THEN 1.0 WHEN pm25_ground IS NOT NULL THEN 0 END) * 100 AS above_pct FROM v_pm25""")
def _distribution(t):
    return profile.distribution_stats(t.v_pm25, "pm25_ground")


@query("histogram", "", """
    WITH s AS (SELECT min(pm25_ground) AS lo, max(pm25_ground) AS hi FROM v_pm25)
    SELECT CAST(least(floor((pm25_ground - lo) / ((hi - lo) / 60)), 59) AS BIGINT) AS bin, count(*) AS count FROM v_pm25, s GROUP BY 1""")
def _histogram(t):
    return profile.histogram(t.v_pm25, "pm25_ground")


@query("density_2d", "", """
    WITH p AS (SELECT aod_550nm AS x, pm25_ground AS y FROM v_features WHERE aod_550nm IS NOT NULL AND pm25_ground IS NOT NULL),
         s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
    SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 40)), 39) AS BIGINT) AS x_bin, CAST(least(floor((y - y0) / ((y1 - y0) / 40)), 39) AS BIGINT) AS y_bin,
           count(*) AS count FROM p, s GROUP BY ALL""")
def _density(t):
    return profile.density_2d(t.v_features, "aod_550nm", "pm25_ground")


_PCT = {f"above_p{format(p * 100, 'g').replace('.', '_')}": p for p in profile.OUTLIER_PERCENTILES}


@query("iqr_outliers", "outlier_threshold extreme_threshold", f"""
    WITH x AS (SELECT pm25_ground AS v FROM v_pm25),
         q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, {', '.join(f'quantile_cont(v, {p}) AS {n}_t' for n, p in _PCT.items())} FROM x)
    SELECT max(q3 + 1.5 * (q3 - q1)) AS outlier_threshold, max(q3 + 3.0 * (q3 - q1)) AS extreme_threshold,
           count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) FILTER (v > q3 + 3.0 * (q3 - q1)) AS extremes,
           {', '.join(f'count(*) FILTER (v > {n}_t) AS {n}' for n in _PCT)} FROM x, q""")
def _outliers(t):
    return profile.iqr_outliers(t.v_pm25, "pm25_ground")


_MI = ["aod_550nm", "satellite_no2", "temperature_2m"]
_EDGES = ", ".join(f"quantile_cont({c}, {i / 10}) AS {c}_{i}" for c in [*_MI, "pm25_ground"] for i in range(1, 10))


def _code(c: str) -> str:
    return " + ".join(f"CASE WHEN {c} > {c}_{i} THEN 1 ELSE 0 END" for i in range(1, 10))


@query("mutual_information", "mi", f"""
    WITH x AS (SELECT {', '.join(_MI)}, pm25_ground FROM v_features WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_MI, 'pm25_ground'])}),
         e AS (SELECT {_EDGES} FROM x),
         j AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {_code(f)} AS fb, {_code('pm25_ground')} AS tb FROM x, e" for f in _MI)}),
         c AS (SELECT feature, fb, tb, count(*)::DOUBLE AS c FROM j GROUP BY ALL),
         w AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, fb) AS cx,
                      sum(c) OVER (PARTITION BY feature, tb) AS cy FROM c),
         m AS (SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM w GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS INT) AS rank FROM m""")
def _mutual(t):
    return profile.mutual_information(t.v_features, _MI, "pm25_ground")


@query("composite_median", "median", """
    SELECT CAST(floor(latitude) AS BIGINT) AS lat_cell, CAST(floor(longitude) AS BIGINT) AS lon_cell, strftime(timestamp_utc, '%Y-%m') AS month,
           count(*) FILTER (aod_qa_flag >= 2) AS pixel_count, count(*) AS all_pixels,
           median(CASE WHEN aod_qa_flag >= 2 THEN aod_550nm * 0.5 END) AS median
    FROM v_pixels GROUP BY ALL""")
def _composite(t):
    cells = t.v_pixels.select(F.floor("latitude").alias("lat_cell"), F.floor("longitude").alias("lon_cell"),
                              F.date_format(F.col("timestamp_utc").cast("timestamp"), "yyyy-MM").alias("month"), "aod_550nm", "aod_qa_flag")
    return profile.composite_median(cells, ["lat_cell", "lon_cell", "month"], "aod_550nm", F.col("aod_qa_flag") >= 2, 0.5)


@query("composite_daily_mean", "mean", """
    SELECT station_id, strftime(timestamp_utc, '%Y-%m-%d') AS date, avg(aod_550nm) * 0.001 AS mean, count(*) AS granules FROM v_sat_events GROUP BY ALL""")
def _daily_composite(t):
    return profile.composite_daily_mean(t.v_sat_events, "aod_550nm", ["station_id"]).withColumn("date", F.col("date").cast("string"))


# a fixed linear estimate stands in for a model
_PRED = "20 + 95 * coalesce(aod_550nm, 3) - 0.8 * coalesce(wind_speed_10m, 7)"


def _predicted(t):
    value = 20 + 95 * F.coalesce("aod_550nm", F.lit(3.0)) - 0.8 * F.coalesce("wind_speed_10m", F.lit(7.0))
    return t.v_features.withColumn("predicted", value)


@query("regression_metrics", "mae rmse r2", f"""
    SELECT city_key, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
           1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
    FROM (SELECT city_key, pm25_ground AS y, {_PRED} AS p FROM v_features WHERE pm25_ground IS NOT NULL) GROUP BY 1""")
def _metrics(t):
    return profile.regression_metrics(_predicted(t), "pm25_ground", "predicted", ["city_key"])


@query("bias_category_accuracy", "bias category_accuracy", f"""
    SELECT city_key, count(*) AS n, avg(p - y) AS bias, avg(CASE WHEN {S.category('sy')} = {S.category('sp')} THEN 1.0 ELSE 0 END) AS category_accuracy
    FROM (SELECT *, {S.subindex('y', 'pm25')} AS sy, {S.subindex('p', 'pm25')} AS sp FROM
          (SELECT city_key, pm25_ground AS y, {_PRED} AS p FROM v_features WHERE pm25_ground IS NOT NULL)) GROUP BY 1""")
def _bias(t):
    return profile.bias_category_accuracy(_predicted(t), "pm25_ground", "predicted", ["city_key"])


_LEAD = ", ".join(f"lead(pm25_ground, {h}) OVER w AS l{h}" for h in K.HORIZON_HOURS)


@query("persistence_baseline", "mae rmse gain_pct", f"""
    WITH x AS (SELECT pm25_ground AS y, {_LEAD} FROM v_pm25 WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc, event_id))
    {' UNION ALL '.join(f"SELECT {h} AS horizon_hours, count(l{h} - y) AS n, coalesce(avg(abs(l{h} - y)), 0) AS mae, coalesce(sqrt(avg((l{h} - y) * (l{h} - y))), 0) AS rmse, (avg(abs(l{h} - y)) - 30.0) / avg(abs(l{h} - y)) * 100 AS gain_pct FROM x" for h in K.HORIZON_HOURS)}""")
def _persistence(t):
    leads = series.lag_lead_features(t.v_pm25, tie=["event_id"], lags=[])
    return profile.persistence_baseline(leads, "pm25_ground", model_mae={h: 30.0 for h in K.HORIZON_HOURS})


@query("seasonal_naive_baseline", "mae rmse r2", """
    SELECT count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
    FROM (SELECT a.o3 AS y, b.o3 AS p FROM v_obs_hourly a JOIN v_obs_hourly b
          ON a.station_id = b.station_id AND b.timestamp_utc = a.timestamp_utc - INTERVAL 24 HOUR WHERE a.o3 IS NOT NULL AND b.o3 IS NOT NULL)""")
def _seasonal(t):
    return profile.seasonal_naive_baseline(t.v_obs_hourly, "o3")


_HORIZON = """SELECT record_id, h AS horizon_hours, pm25_ground * (1 + ((record_id + h * 7) % 10 - 5) / 20.0::DOUBLE) AS predicted_pm25
              FROM v_features, (VALUES (1), (6), (12), (24)) AS hh(h) WHERE pm25_ground IS NOT NULL"""


def _horizons(t):
    cells = F.array(*[F.lit(h) for h in K.HORIZON_HOURS])
    out = t.v_features.filter(F.col("pm25_ground").isNotNull()).select("record_id", "pm25_ground", F.explode(cells).alias("horizon_hours"))
    factor = 1 + ((F.col("record_id") + F.col("horizon_hours") * 7) % 10 - 5) / 20.0
    out = out.withColumn("predicted_pm25", F.col("pm25_ground") * factor)
    return out.withColumn("category", aqi.pm25_category(F.col("predicted_pm25"))).drop("pm25_ground")


@query("best_horizon_window", "lowest_predicted_pm25 peak_hazard_pm25", f"""
    WITH x AS (SELECT *, {S.subindex('predicted_pm25', 'pm25')} AS s FROM ({_HORIZON})), c AS (SELECT *, {S.category('s')} AS category FROM x),
         g AS (SELECT record_id, arg_min(struct_pack(h := horizon_hours, p := predicted_pm25, c := category), row(predicted_pm25, horizon_hours)) AS b,
                      arg_max(struct_pack(h := horizon_hours, p := predicted_pm25, c := category), row(predicted_pm25, -horizon_hours)) AS w FROM c GROUP BY 1)
    SELECT record_id, CASE WHEN b.h > 1 THEN 'In +' || b.h || ' hour(s)' ELSE 'Next 1-2 hours' END || ' (' || b.c || ' air quality)' AS recommended_window,
           b.p AS lowest_predicted_pm25, w.p AS peak_hazard_pm25, '+' || w.h || 'h' AS peak_hazard_horizon FROM g""")
def _window(t):
    return profile.best_horizon_window(_horizons(t), ["record_id"]).drop("advice")


@query("conformal_calibration", "qhat coverage_pct mean_width", f"""
    WITH r AS (SELECT record_id % 3 <> 0 AS cal, distance_to_station_km AS d, abs(pm25_ground - ({_PRED})) AS res FROM v_features WHERE pm25_ground IS NOT NULL),
         q AS (SELECT res AS q FROM (SELECT res, row_number() OVER (ORDER BY res) AS k, count(*) OVER () AS n FROM r WHERE cal)
               WHERE k = least(ceil((n + 1) * 0.9::DOUBLE), n)),
         t AS (SELECT *, q * (1 + 0.35 * sqrt(d / 10)) AS half FROM r, q WHERE NOT cal)
    SELECT CASE WHEN d <= 5 THEN '0-5' WHEN d <= 20 THEN '5-20' WHEN d <= 50 THEN '20-50' ELSE '>50' END AS bracket, count(*) AS n, max(q) AS qhat,
           avg(CASE WHEN res <= half THEN 1.0 ELSE 0 END) * 100 AS coverage_pct, avg(2 * half) AS mean_width FROM t GROUP BY 1""")
def _conformal(t):
    return profile.conformal_calibration(_predicted(t), "pm25_ground", "predicted", "distance_to_station_km", F.col("record_id") % 3 != 0)


@query("station_latest", "latitude longitude pm25 aqi", f"""
    WITH l AS (SELECT station_id, arg_max(struct_pack(v := pm25_ground, t := timestamp_utc), row(timestamp_utc, event_id)) AS b FROM v_pm25 GROUP BY 1),
         x AS (SELECT s.station_id, s.name, s.latitude, s.longitude, b.v AS pm25, b.t AS last_updated, {S.subindex('b.v', 'pm25')} AS s0
               FROM v_stations s LEFT JOIN l USING (station_id))
    SELECT station_id, name, latitude, longitude, pm25, last_updated, aqi, {S.category('aqi')} AS category, {S.color('aqi')} AS color,
           CASE WHEN last_updated IS NULL THEN 'NO DATA' ELSE 'ACTIVE' END AS status FROM (SELECT *, {S.bround('s0')} AS aqi FROM x)""")
def _latest(t):
    return matching.station_latest(t.v_pm25, t.v_stations.select("station_id", "name", "latitude", "longitude"), "pm25_ground", ["event_id"])


@query("recent_history", "pm25_ground aqi", f"""
    SELECT event_id, station_id, timestamp_utc, pm25_ground, {S.bround('s')} AS aqi, {S.category('s')} AS category FROM (
      SELECT e.*, {S.subindex('pm25_ground', 'pm25')} AS s FROM v_pm25 e
      JOIN (SELECT station_id, max(timestamp_utc) AS last FROM v_pm25 GROUP BY 1) USING (station_id)
      WHERE timestamp_utc > last - INTERVAL 48 HOUR)""")
def _history(t):
    return matching.recent_history(t.v_pm25, "pm25_ground", 48)

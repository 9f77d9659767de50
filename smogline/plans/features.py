"""Queries of feature engineering and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.operators import cleaning, features, imputing
from smogline.plans import sqltext as S
from smogline.plans.canonical import build_canonical
from smogline.plans.joins import nearest_sql, temporal_sql
from smogline.plans.registry import query

_TAU = "(2 * pi())"
_CYCLE = ", ".join(f"sin({f}(timestamp_utc) * ({_TAU} / {n})) AS {name}_sin, cos({f}(timestamp_utc) * ({_TAU} / {n})) AS {name}_cos"
                   for name, f, n in (("hour", "hour", 24), ("month", "month", 12), ("doy", "dayofyear", 365)))
_CYCLE_NAMES = "hour_sin hour_cos month_sin month_cos doy_sin doy_cos wind_u wind_v"
_WIND = "-sin(radians(wind_direction_10m)) AS wind_u, -cos(radians(wind_direction_10m)) AS wind_v"


@query("cyclic_encode", _CYCLE_NAMES, f"SELECT record_id, {_CYCLE}, {_WIND} FROM v_features")
def _cyclic(t):
    return features.cyclic_encode(features.time_parts(t.v_features.select("record_id", "timestamp_utc", "wind_direction_10m"))
                                  ).drop("timestamp_utc")


_LOGS = K.LOG_COLUMNS


@query("log_transform", " ".join(_LOGS), "SELECT record_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c} - 1, 0)) END AS {c}" for c in _LOGS) + " FROM v_features")
def _logs(t):
    shifted = t.v_features.select("record_id", *[(F.col(c) - 1).alias(c) for c in _LOGS])
    return features.log_transform(shifted)


_RAW = ["aod_550nm", "boundary_layer_height", "wind_speed_10m", "road_density", "relative_humidity_2m", "temperature_2m"]
_INTER = "aod_pblh_ratio wind_road_exposure rh_pblh heat_index_proxy"


def _interactions(source: str, medians: str) -> str:
    b, r, w = (f"coalesce({c}, (SELECT median({c}) FROM {medians}))" for c in ("boundary_layer_height", "relative_humidity_2m", "temperature_2m"))
    return (f"SELECT *, coalesce(aod_550nm, 0) / nullif(coalesce(boundary_layer_height, 1), 0) AS aod_pblh_ratio, "
            f"coalesce(wind_speed_10m, 0) * coalesce(road_density, 0) AS wind_road_exposure, {r} * {b} AS rh_pblh, "
            f"{w} + 0.33::DOUBLE * ({r} / 100 * 6.1078::DOUBLE * exp(17.27::DOUBLE * {w} / ({w} + 237.3))) - 4.0 AS heat_index_proxy FROM {source}")


@query("interaction_features", " ".join(_RAW) + " " + _INTER, f"""
    WITH x AS (SELECT record_id, {', '.join(_RAW)} FROM v_features) {_interactions('x', 'x')}""")
def _inter(t):
    return features.interaction_features(t.v_features.select("record_id", *_RAW))


_SCALED = ["temperature_2m", "wind_speed_10m", "surface_pressure", "road_density"]


@query("standardise", " ".join(_SCALED), f"""
    WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}' for c in _SCALED)} FROM v_features WHERE city_key <> 4)
    SELECT record_id, {', '.join(f'({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END AS {c}' for c in _SCALED)} FROM v_features, s""")
def _standard(t):
    fitted = features.fit_scaler(t.v_features.filter("city_key <> 4"), _SCALED)
    return features.standardise(t.v_features.select("record_id", *_SCALED), _SCALED, fitted)


_MED = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "boundary_layer_height", "elevation_m"]
_CONST = {"wind_direction_10m": 180.0, "precipitation_1h": 0.0, "road_density": 0.0}


@query("impute_policy", " ".join(_MED) + " " + " ".join(_CONST) + " aod_550nm pm25_ground", f"""
    WITH x AS (SELECT * FROM v_features WHERE pm25_ground IS NOT NULL)
    SELECT record_id, pm25_ground, aod_550nm, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM x)) AS {c}' for c in _MED)},
           {', '.join(f'coalesce({c}, {v}) AS {c}' for c, v in _CONST.items())},
           CASE WHEN aod_550nm IS NULL THEN 1 ELSE 0 END AS is_aod_missing, CASE WHEN temperature_2m IS NULL THEN 1 ELSE 0 END AS is_temperature_2m_missing
    FROM x""")
def _policy(t):
    out = imputing.impute_policy(t.v_features)
    return out.select("record_id", "pm25_ground", "aod_550nm", *_MED, *_CONST, "is_aod_missing", "is_temperature_2m_missing")


@query("climatology_impute", "aod_550nm satellite_no2", """
    WITH x AS (SELECT record_id, CAST(floor(latitude) AS BIGINT) AS lat_cell, CAST(floor(longitude) AS BIGINT) AS lon_cell, month(timestamp_utc) AS m,
                      timestamp_utc, aod_550nm, satellite_no2 FROM v_features),
         c AS (SELECT lat_cell, lon_cell, m, median(aod_550nm) AS a, median(satellite_no2) AS n FROM x GROUP BY ALL)
    SELECT record_id, lat_cell, lon_cell, timestamp_utc, coalesce(aod_550nm, a) AS aod_550nm, coalesce(satellite_no2, n) AS satellite_no2
    FROM x JOIN c USING (lat_cell, lon_cell, m)""")
def _climatology(t):
    cells = t.v_features.select("record_id", F.floor("latitude").alias("lat_cell"), F.floor("longitude").alias("lon_cell"),
                                "timestamp_utc", "aod_550nm", "satellite_no2")
    return imputing.climatology_impute(cells, ["aod_550nm", "satellite_no2"])


_FULL = K.FEATURE_GROUPS["full"]
_KEPT = [c for c in _FULL if c != "wind_direction_10m"]
_PLAIN = [c for c in _KEPT if c not in K.LOG_COLUMNS and not c.endswith("_missing")]


@query("feature_matrix", " ".join([*[c for c in _KEPT if not c.endswith("_missing")], *_CYCLE_NAMES.split(), *_INTER.split(), "pm25_ground"]), f"""
    WITH b AS (SELECT record_id, pm25_ground, {', '.join(_PLAIN)},
                      {', '.join(f'CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END AS {c}' for c in K.LOG_COLUMNS)},
                      {_CYCLE}, {_WIND} FROM v_features)
    {_interactions('b', 'b')}""")
def _matrix(t):
    return features.feature_matrix(t.v_features.withColumn("aqi_label", F.lit(1.0)), "full", keep=["record_id"])


@query("feature_groups", "", """
    SELECT 'weather_only' AS feature_group, 16 AS features, count(*) AS rows FROM v_features UNION ALL
    SELECT 'weather_gis', 23, count(*) FROM v_features UNION ALL SELECT 'full', 30, count(*) FROM v_features""")
def _groups(t):
    parts = []
    for name in K.FEATURE_GROUPS:
        made = features.FeatureSet(name).fit(t.v_features)
        parts.append(made.transform(t.v_features).agg(F.lit(name).alias("feature_group"), F.lit(len(made.names)).alias("features"),
                                                      F.count(F.lit(1)).alias("rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _canonical_sql() -> str:
    seen = "v_stations_seen AS (SELECT station_id, min(latitude) AS latitude, min(longitude) AS longitude FROM v_ground_located GROUP BY 1)"
    def cell(c):
        return f"round_even({c}, 2)"
    hour = S.round_hour("timestamp_utc")
    return f"""
    WITH {seen}, placed AS (SELECT * FROM ({nearest_sql("v_sat_pixels", "v_stations_seen", 60.0)}) WHERE station_id IS NOT NULL),
      pairs AS ({temporal_sql("placed", "v_ground_located", 90)}),
      raw AS (SELECT timestamp_utc + INTERVAL 9000 DAY AS timestamp_utc, latitude, longitude,
                     CASE WHEN temperature_2m - 273.15 BETWEEN -50 AND 60 THEN temperature_2m - 273.15 END AS temperature_2m,
                     CASE WHEN surface_pressure / 100 BETWEEN 500 AND 1100 THEN surface_pressure / 100 END AS surface_pressure FROM v_weather),
      w AS (SELECT {hour} AS h, {cell('latitude')} AS a, {cell('longitude')} AS o, avg(temperature_2m) AS temperature_2m,
                   avg(surface_pressure) AS surface_pressure FROM raw GROUP BY 1, 2, 3),
      s AS (SELECT {cell('latitude')} AS a, {cell('longitude')} AS o, least(greatest(road_density, 0), 50) AS road_density FROM v_static
            QUALIFY row_number() OVER (PARTITION BY {cell('latitude')}, {cell('longitude')} ORDER BY location_id) = 1),
      j AS (SELECT p.*, w.temperature_2m, w.surface_pressure, coalesce(s.road_density, 0) AS road_density FROM pairs p
            LEFT JOIN w ON w.h = {S.round_hour('p.timestamp_utc')} AND w.a = {cell('p.latitude')} AND w.o = {cell('p.longitude')}
            LEFT JOIN s ON s.a = {cell('p.latitude')} AND s.o = {cell('p.longitude')})
    SELECT 'cell_' || replace(CAST({cell('latitude')} AS VARCHAR), '.', '') || '_' || replace(CAST({cell('longitude')} AS VARCHAR), '.', '') AS location_id,
           station_id, timestamp_utc AS satellite_timestamp, pm25 AS pm25_ground, aod_550nm,
           coalesce(temperature_2m, (SELECT median(temperature_2m) FROM j)) AS temperature_2m, surface_pressure, road_density,
           distance_to_station_km, temporal_offset_minutes FROM j"""


@query("canonical_dataset", "pm25_ground aod_550nm temperature_2m surface_pressure road_density distance_to_station_km temporal_offset_minutes",
       _canonical_sql())
def _canonical(t):
    weather = cleaning.clean_weather(t.v_weather)
    # weather years are moved to the observations' year, as the tables' clocks differ
    shifted = weather.withColumn("timestamp_utc", F.col("timestamp_utc") + F.expr("INTERVAL 9000 DAYS"))
    out = build_canonical(t.v_sat_pixels, t.v_ground_located, shifted, cleaning.impute_landuse(cleaning.clean_static(t.v_static)),
                          radius_km=60.0, window_minutes=90.0, static_order=["location_id"])
    return out.select("location_id", "station_id", "satellite_timestamp", "pm25_ground", "aod_550nm", "temperature_2m", "surface_pressure",
                      "road_density", "distance_to_station_km", "temporal_offset_minutes")

"""Queries of the index and risk functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.functions import aqi, meteo, risk
from smogline.operators import indices, matching
from smogline.plans import sqltext as S
from smogline.plans.registry import query

_SUB = {  # name -> (pollutant, table, gap)
    "pm25_domain": ("pm25", "domain", "continuous"), "pm25_open": ("pm25", "domain", "reference"),
    "pm25_station": ("pm25", "station", "reference"), "pm10_domain": ("pm10", "domain", "continuous"),
    "no2_domain": ("no2", "domain", "continuous"), "so2_domain": ("so2", "domain", "continuous"),
    "co_domain": ("co", "domain", "continuous"), "o3_domain": ("o3", "domain", "continuous"),
    "co_station": ("co", "station", "reference"), "o3_station": ("o3", "station", "continuous"),
}
# a wide spread of concentrations, negative ones included
_SPREAD = {"pm25": 1.0, "pm10": 1.0, "no2": 1.6, "so2": 4.0, "co": 0.1, "o3": 2.0}


@query("naqi_subindex", "value " + " ".join(_SUB), "SELECT record_id, value, " + ", ".join(
    f"{S.subindex(f'x_{p}', p, table, gap)} AS {n}" for n, (p, table, gap) in _SUB.items())
    + " FROM (SELECT record_id, value, " + ", ".join(f"value * {k}::DOUBLE AS x_{p}" for p, k in _SPREAD.items())
    + " FROM (SELECT record_id, aod_550nm * 100 - 20 AS value FROM v_pixels))")
def _subindex(t):
    value = F.col("value")
    return t.v_pixels.select("record_id", (F.col("aod_550nm") * 100 - 20).alias("value")).withColumns(
        {n: aqi.subindex(value * _SPREAD[p], p, table, gap) for n, (p, table, gap) in _SUB.items()})


_P = ["pm25", "no2", "so2", "co", "o3"]
_OVERALL_OUT = " ".join(_P) + " aqi"


@query("naqi_overall", _OVERALL_OUT, f"""
    SELECT *, {S.category('aqi')} AS category, {S.color('aqi')} AS color,
           CASE WHEN aqi IS NULL THEN 'No measurements provided.' ELSE {S.advisory('aqi')} END AS health_advisory,
           {' + '.join(f'CASE WHEN {p} IS NULL THEN 0 ELSE 1 END' for p in _P)} AS n_pollutants
    FROM ({S.with_index(_P, 'v_obs_hourly')})""")
def _overall(t):
    return indices.with_overall(t.v_obs_hourly, _P)


_COARSE = ", ".join(f"floor({p} / 40) * 40 AS {p}" for p in _P)
_BOUNDED = ", ".join(f"CASE WHEN {p} BETWEEN {K.POLLUTANT_LIMITS[p][0]} AND {K.POLLUTANT_LIMITS[p][1]} THEN {p} END AS {p}" for p in _P)
_MOVING = ", ".join(f"CASE WHEN {' AND '.join(f'{p} = lag({p}, {k}) OVER w' for k in (1, 2, 3))} THEN NULL ELSE {p} END AS {p}" for p in _P)
_STATION_SUBS = ", ".join(f"{S.subindex(p, p, 'station', 'reference')} AS {p}_subindex" for p in _P)


@query("clean_station_readings", " ".join([*_P, *[f"{p}_subindex" for p in _P], "aqi_calculated"]), f"""
    SELECT *, CASE WHEN aqi_calculated IS NULL THEN NULL {' '.join(f"WHEN {p}_subindex = aqi_calculated THEN '{p.upper()}'" for p in _P)} END AS dominant_pollutant,
           CASE WHEN aqi_calculated IS NOT NULL THEN {S.category('aqi_calculated')} END AS aqi_category
    FROM (SELECT *, greatest({', '.join(f'{p}_subindex' for p in _P)}) AS aqi_calculated
          FROM (SELECT *, {_STATION_SUBS}
                FROM (SELECT station_id, timestamp_utc, {_MOVING} FROM (SELECT station_id, timestamp_utc, {_BOUNDED} FROM (SELECT station_id, timestamp_utc, {_COARSE} FROM v_obs_hourly))
                      WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc))))""")
def _station_readings(t):
    # coarse values, so that equal runs occur, under the names that stations use
    raw = t.v_obs_hourly.select("station_id", "timestamp_utc", *[(F.floor(F.col(p) / 40) * 40.0).alias(p.upper() if p != "pm25" else "PM2.5") for p in _P])
    return indices.clean_station_readings(raw).select("station_id", "timestamp_utc", *_P, *[f"{p}_subindex" for p in _P], "aqi_calculated", "dominant_pollutant", "aqi_category")


@query("naqi_official", "aqi", f"""
    SELECT station_id, timestamp_utc, CASE WHEN pm25 IS NOT NULL AND
        {' + '.join(f'CASE WHEN {p} IS NULL THEN 0 ELSE 1 END' for p in _P)} >= 3 THEN aqi END AS aqi
    FROM ({S.with_index(_P, 'v_obs_hourly')})""")
def _official(t):
    return indices.with_overall(t.v_obs_hourly, _P, min_pollutants=3).select("station_id", "timestamp_utc", "aqi")


@query("aqi_category", "aqi", f"""
    SELECT record_id, aqi, {S.category('aqi')} AS by_rounding, {S.category('aqi', False)} AS by_value
    FROM (SELECT record_id, CASE WHEN record_id % 50 = 0 THEN NULL ELSE aod_550nm * 95 END AS aqi FROM v_pixels)""")
def _category(t):
    value = F.when(F.col("record_id") % 50 != 0, F.col("aod_550nm") * 95)
    return t.v_pixels.select("record_id", value.alias("aqi")).withColumns(
        {"by_rounding": aqi.category(F.col("aqi")), "by_value": aqi.category(F.col("aqi"), rounding=False)})


def _case(value: str, table: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


@query("category_colors", "", f"""
    SELECT record_id, {S.color('aqi')} AS by_index, {_case('c', {e[1]: e[2] for e in K.CATEGORIES}, "'#00B050'")} AS by_category,
           {_case('c', K.ADVISORY_COLORS, "'#ffbf00'")} AS advisory,
           {', '.join(f"{_case('c', {k: v[i] for k, v in K.OVERLAY_RGBA.items()}, '0')} AS {n}" for i, n in enumerate(('red', 'green', 'blue', 'alpha')))}
    FROM (SELECT record_id, aqi, {S.category('aqi', False)} AS c FROM (SELECT record_id, aod_550nm * 95 AS aqi FROM v_pixels))""")
def _colors(t):
    value = F.col("aqi")
    name = aqi.category(value, rounding=False)
    rgba = aqi.overlay_rgba(value)
    return t.v_pixels.select("record_id", (F.col("aod_550nm") * 95).alias("aqi")).select(
        "record_id", aqi.color_of_index(value).alias("by_index"), aqi.color_of_category(name).alias("by_category"),
        aqi.advisory_color(name).alias("advisory"), rgba["r"].alias("red"), rgba["g"].alias("green"),
        rgba["b"].alias("blue"), rgba["a"].alias("alpha"))


@query("pm25_to_naqi", "pm25_ground aqi", f"""
    SELECT record_id, pm25_ground, {S.bround('s')} AS aqi, {S.category('s')} AS category
    FROM (SELECT record_id, pm25_ground, {S.subindex('pm25_ground', 'pm25')} AS s FROM v_features)""")
def _pm25(t):
    return t.v_features.select("record_id", "pm25_ground", aqi.pm25_index(F.col("pm25_ground")).alias("aqi"),
                               aqi.pm25_category(F.col("pm25_ground")).alias("category"))


@query("prediction_interval", "confidence_level pm25_predicted margin_of_error pm25_lower_bound pm25_upper_bound uncertainty_percentage", f"""
    SELECT record_id, {S.bround('y')} AS pm25_predicted, margin_of_error, greatest(0.0, {S.bround('lo')}) AS pm25_lower_bound,
           {S.bround('hi')} AS pm25_upper_bound, 0.9::DOUBLE AS confidence_level, pct AS uncertainty_percentage,
           CASE WHEN pct < 20 THEN 'LOW' WHEN pct < 40 THEN 'MEDIUM' ELSE 'HIGH' END AS uncertainty_level
    FROM (SELECT *, {S.bround('p')} AS pct FROM (SELECT *, y - margin_of_error AS lo, y + margin_of_error AS hi,
                 margin_of_error / greatest(y, 20.0) * 100.0 AS p
          FROM (SELECT *, {S.bround('m')} AS margin_of_error FROM (
            SELECT record_id, pm25_ground AS y, 1.645::DOUBLE * (12.5::DOUBLE * (1.0 + 0.03::DOUBLE * least(distance_to_station_km, 30.0))
              * CASE WHEN aod_550nm IS NULL THEN 1.45::DOUBLE ELSE 1.0 END * CASE WHEN boundary_layer_height < 400 THEN 1.25::DOUBLE ELSE 1.0 END) AS m
            FROM v_features WHERE pm25_ground IS NOT NULL))))""")
def _interval(t):
    known = t.v_features.filter(F.col("pm25_ground").isNotNull())
    struct = risk.prediction_interval(F.col("pm25_ground"), F.col("distance_to_station_km"),
                                      F.col("aod_550nm").isNull(), F.col("boundary_layer_height"))
    return known.select("record_id", struct.alias("i")).select("record_id", "i.*")


@query("reliability_score", "distance_to_station_km", f"""
    SELECT record_id, CAST(greatest(least(s, 99), 25) AS INT) AS reliability_score,
           CASE WHEN s >= 80 THEN 'HIGH' WHEN s >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS reliability_level,
           aod_550nm IS NOT NULL AS modis_aod, satellite_no2 IS NOT NULL AS tropomi_no2, {S.bround('distance_to_station_km', 2)} AS distance_to_station_km
    FROM (SELECT record_id, aod_550nm, satellite_no2, distance_to_station_km, round_even(100.0::DOUBLE - least(distance_to_station_km * 1.5, 30.0) - CASE WHEN aod_550nm IS NULL THEN 22 ELSE 0 END
                 - CASE WHEN satellite_no2 IS NULL THEN 10 ELSE 0 END - least((record_id % 100) / 100.0::DOUBLE * 20, 15), 0) AS s FROM v_features)""")
def _reliability(t):
    struct = risk.reliability(F.col("distance_to_station_km"), F.col("aod_550nm").isNull(), F.col("satellite_no2").isNull(),
                              (F.col("record_id") % 100) / 100.0)
    return t.v_features.select("record_id", struct.alias("r")).select("record_id", "r.reliability_score", "r.reliability_level", "r.inputs_verified.modis_aod",
                                                                            "r.inputs_verified.tropomi_no2", "r.inputs_verified.distance_to_station_km")


_DELTA_KM = S.flat("p.latitude", "p.longitude", "s.latitude", "s.longitude")


@query("station_delta", "distance_km delta_pm25 nearest_station_pm25 hyperlocal_pm25", f"""
    WITH m AS (SELECT station_id, avg(pm25_ground) AS station_pm25 FROM v_pm25 GROUP BY 1),
         s AS (SELECT station_id, name, latitude, longitude, station_pm25 FROM v_stations JOIN m USING (station_id)),
         n AS (SELECT record_id, pm25_ground, s.name, s.station_pm25, round({_DELTA_KM}, 6) AS km
               FROM (SELECT * FROM v_features WHERE pm25_ground IS NOT NULL) p, s
               QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round({_DELTA_KM}, 6), s.station_id) = 1),
         d AS (SELECT *, pm25_ground - station_pm25 AS raw FROM n)
    SELECT record_id, name, {S.bround('km', 2)} AS distance_km, {S.bround('raw')} AS delta_pm25,
           CASE WHEN {S.bround('raw')} > 0 THEN 'HIGHER' WHEN {S.bround('raw')} < 0 THEN 'LOWER' ELSE 'EQUAL' END AS delta_direction,
           station_pm25 AS nearest_station_pm25, {S.bround('pm25_ground')} AS hyperlocal_pm25 FROM d""")
def _delta(t):
    means = t.v_pm25.groupBy("station_id").agg(F.avg("pm25_ground").alias("station_pm25"))
    stations = t.v_stations.join(means, "station_id")
    points = t.v_features.filter(F.col("pm25_ground").isNotNull()).select("record_id", "latitude", "longitude", "pm25_ground")
    near = matching.nearest_reference_point(points, stations, ["name", "station_pm25"], ["station_id"], ref_lat="latitude", ref_lon="longitude")
    struct = risk.station_delta(F.col("pm25_ground"), F.col("station_pm25"), F.col("name"), F.col("distance_km"))
    return near.withColumn("d", struct).select("record_id", "name", "distance_km", "d.delta_pm25", "d.delta_direction", "d.nearest_station_pm25", "d.hyperlocal_pm25")


@query("prediction_id", "", """
    SELECT record_id, 'PRED-' || upper(substr(sha256(concat_ws(':', CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR),
           CAST(timestamp_utc AS VARCHAR), 'v1')), 1, 12)) AS prediction_id FROM v_pixels""")
def _prediction_id(t):
    return t.v_pixels.select("record_id", risk.prediction_id(F.col("latitude"), F.col("longitude"), F.col("timestamp_utc"),
                                                             F.lit("v1")).alias("prediction_id"))


@query("aod_surface_proxy", "proxy", """
    SELECT record_id, CASE WHEN boundary_layer_height <> 0 AND relative_humidity_2m < 100
           THEN 1000.0::DOUBLE * (aod_550nm / boundary_layer_height) * pow(1 - relative_humidity_2m / 100, -0.25) END AS proxy FROM v_features""")
def _proxy(t):
    value = meteo.aod_surface_proxy(F.col("aod_550nm"), F.col("boundary_layer_height"), F.col("relative_humidity_2m"), 1000.0)
    return t.v_features.select("record_id", value.alias("proxy"))

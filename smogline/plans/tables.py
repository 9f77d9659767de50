"""Queries of cleaners, unit conversions, keys and time parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.functions import clock, meteo
from smogline.operators import cleaning
from smogline.operators.quantiles import exact_quantiles
from smogline.plans import sqltext as S
from smogline.plans.registry import query


@query("alias_harmonise", "pm25_ground satellite_no2 temperature_2m wind_speed_10m", """
    SELECT record_id, CAST(station_id AS VARCHAR) AS station_id, pm25_ground, satellite_no2, temperature_2m, wind_speed_10m
    FROM v_features WHERE pm25_ground IS NOT NULL""")
def _alias(t):
    odd = t.v_features.select("record_id", F.col("station_id").alias("location_id"), F.col("pm25_ground").alias("PM2.5"),
                              F.col("satellite_no2").alias("NO2"), F.col("temperature_2m").alias("temperature"),
                              F.col("wind_speed_10m").alias("wind_speed"))
    return cleaning.prepare_training(odd).drop("location_id")


_WIDE = ", ".join(f"CASE WHEN parameter = '{p}' THEN value END AS {p}" for p in ("pm25", "no2", "so2", "co", "o3"))


@query("mask_physical_bounds", "pm25 no2 so2 co o3", "SELECT event_id, " + ", ".join(
    f"CASE WHEN parameter = '{p}' AND value BETWEEN {K.POLLUTANT_LIMITS[p][0]} AND {K.POLLUTANT_LIMITS[p][1]} THEN value END AS {p}"
    for p in ("pm25", "no2", "so2", "co", "o3")) + " FROM v_obs_long")
def _bounds(t):
    wide = t.v_obs_long.select("event_id", *[F.when(F.col("parameter") == p, F.col("value")).alias(p)
                                             for p in ("pm25", "no2", "so2", "co", "o3")])
    return cleaning.mask_physical_bounds(wide)


@query("clean_aod", "latitude longitude aod_550nm", """
    SELECT record_id, timestamp_utc, latitude, longitude, aod_qa_flag, v AS aod_550nm,
           CASE WHEN v IS NULL THEN 1 ELSE 0 END AS is_aod_missing
    FROM (SELECT *, CASE WHEN aod_qa_flag >= 2 AND aod_550nm BETWEEN 0 AND 5 THEN aod_550nm END AS v FROM v_pixels)""")
def _aod(t):
    return cleaning.clean_aod(t.v_pixels)


def _gases(t):
    k = F.col("record_id")
    return t.v_features.select(
        "record_id", ((k % 6000) - 500.0).alias("no2_tropospheric_column"), ((k % 1200) - 100.0).alias("so2_column"),
        F.col("satellite_co"), (F.col("satellite_o3") - 0.01).alias("o3_column"), (F.col("uv_aerosol_index") * 4).alias("uv_aerosol_index"),
        F.col("satellite_no2"), ((k % 101) / 100.0).alias("no2_qa_value"), ((k % 11) / 10.0).alias("co_qa_value"))


_GASES = """SELECT record_id, (record_id % 6000) - 500.0::DOUBLE AS no2_tropospheric_column, (record_id % 1200) - 100.0::DOUBLE AS so2_column,
    satellite_co, satellite_o3 - 0.01 AS o3_column, uv_aerosol_index * 4 AS uv_aerosol_index, satellite_no2,
    (record_id % 101) / 100.0::DOUBLE AS no2_qa_value, (record_id % 11) / 10.0::DOUBLE AS co_qa_value FROM v_features"""


def _between(c):
    lo, hi = K.GAS_LIMITS[c]
    return f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END"


@query("clean_trace_gases", "no2_tropospheric_column so2_column satellite_co o3_column uv_aerosol_index satellite_no2 no2_qa_value co_qa_value",
       "SELECT record_id, no2_qa_value, co_qa_value, " + ", ".join(
           f"{_between(c)} AS {c}" for c in ("no2_tropospheric_column", "so2_column", "satellite_co", "o3_column", "uv_aerosol_index", "satellite_no2"))
       + ", " + ", ".join(f"CASE WHEN {_between(c)} IS NULL THEN 1 ELSE 0 END AS is_{c}_missing"
                          for c in ("no2_tropospheric_column", "so2_column", "co_column", "o3_column", "uv_aerosol_index") if c != "co_column")
       + f" FROM ({_GASES})")
def _trace(t):
    return cleaning.clean_trace_gases(_gases(t))


@query("qa_mask_trace_gases", "satellite_no2 satellite_co no2_qa_value co_qa_value", f"""
    SELECT record_id, no2_qa_value, co_qa_value, CASE WHEN no2_qa_value >= 0.75 THEN satellite_no2 END AS satellite_no2,
           CASE WHEN co_qa_value >= 0.5 THEN satellite_co END AS satellite_co FROM ({_GASES})""")
def _qa(t):
    return cleaning.qa_mask_trace_gases(_gases(t).select("record_id", "satellite_no2", "satellite_co", "no2_qa_value", "co_qa_value"))


@query("mask_band_ranges", "wind_speed_10m temperature_2m_celsius surface_pressure_hpa uv_aerosol_index", """
    SELECT record_id, CASE WHEN w <> -9999 AND w BETWEEN 0 AND 100 THEN w END AS wind_speed_10m,
           CASE WHEN t <> -9999 AND t BETWEEN -80 AND 60 THEN t END AS temperature_2m_celsius,
           CASE WHEN p BETWEEN 600 AND 1100 THEN p END AS surface_pressure_hpa,
           CASE WHEN u BETWEEN -5 AND 25 THEN u END AS uv_aerosol_index
    FROM (SELECT record_id, coalesce(wind_speed_10m, -9999) AS w, coalesce(temperature_2m, -9999) * 2 AS t,
                 surface_pressure * 1.1::DOUBLE AS p, uv_aerosol_index * 6 AS u FROM v_features)""")
def _bands(t):
    bands = t.v_features.select(
        "record_id", F.coalesce("wind_speed_10m", F.lit(K.BAND_FILL)).alias("wind_speed_10m"),
        (F.coalesce("temperature_2m", F.lit(K.BAND_FILL)) * 2).alias("temperature_2m_celsius"),
        (F.col("surface_pressure") * 1.1).alias("surface_pressure_hpa"), (F.col("uv_aerosol_index") * 6).alias("uv_aerosol_index"))
    return cleaning.mask_band_ranges(bands)


_RH = "least(greatest(100 * exp(17.625 * ({d}) / (243.04 + ({d})) - 17.625 * ({t}) / (243.04 + ({t}))), 0), 100)"


@query("clean_weather", "temperature_2m dewpoint_temperature_2m u_component_of_wind_10m v_component_of_wind_10m surface_pressure "
       "total_precipitation boundary_layer_height latitude longitude wind_speed_10m wind_direction_10m precipitation_1h relative_humidity_2m", f"""
    SELECT l_orderkey, l_linenumber, timestamp_utc, t AS temperature_2m, dewpoint_temperature_2m, u_component_of_wind_10m,
           v_component_of_wind_10m, CASE WHEN p BETWEEN 500 AND 1100 THEN p END AS surface_pressure, total_precipitation,
           least(greatest(boundary_layer_height, 50), 6000) AS boundary_layer_height, latitude, longitude,
           sqrt(u_component_of_wind_10m * u_component_of_wind_10m + v_component_of_wind_10m * v_component_of_wind_10m) AS wind_speed_10m,
           (degrees(atan2(-u_component_of_wind_10m, -v_component_of_wind_10m)) + 360) % 360 AS wind_direction_10m,
           greatest(total_precipitation, 0) AS precipitation_1h,
           {_RH.format(d='d', t='t')} AS relative_humidity_2m
    FROM (SELECT *, CASE WHEN k BETWEEN -50 AND 60 THEN k END AS t,
                 CASE WHEN surface_pressure > 2000 THEN surface_pressure / 100 ELSE surface_pressure END AS p,
                 CASE WHEN dewpoint_temperature_2m > 150 THEN dewpoint_temperature_2m - 273.15 ELSE dewpoint_temperature_2m END AS d
          FROM (SELECT *, CASE WHEN temperature_2m > 150 THEN temperature_2m - 273.15 ELSE temperature_2m END AS k FROM v_weather))""")
def _weather(t):
    return cleaning.clean_weather(t.v_weather)


@query("wind_from_uv", "speed direction toward", """
    SELECT l_orderkey, l_linenumber, sqrt(u * u + v * v) AS speed, (degrees(atan2(-u, -v)) + 360) % 360 AS direction,
           (degrees(atan2(u, v)) + 360) % 360 AS toward
    FROM (SELECT l_orderkey, l_linenumber, u_component_of_wind_10m AS u, v_component_of_wind_10m AS v FROM v_weather)""")
def _wind(t):
    u, v = F.col("u_component_of_wind_10m"), F.col("v_component_of_wind_10m")
    return t.v_weather.select("l_orderkey", "l_linenumber", meteo.wind_speed(u, v).alias("speed"),
                              meteo.wind_from(u, v).alias("direction"), meteo.wind_toward(u, v).alias("toward"))


@query("relative_humidity", "rh rh_linear", f"""
    SELECT l_orderkey, l_linenumber, {_RH.format(d='(dewpoint_temperature_2m - 273.15)', t='(temperature_2m - 273.15)')} AS rh,
           100 * exp((dewpoint_temperature_2m - temperature_2m) * (17.67::DOUBLE / 243.5)) AS rh_linear FROM v_weather""")
def _rh(t):
    air, dew = F.col("temperature_2m"), F.col("dewpoint_temperature_2m")
    return t.v_weather.select("l_orderkey", "l_linenumber",
                              meteo.humidity(meteo.celsius(air), meteo.celsius(dew)).alias("rh"),
                              meteo.humidity_linear(air, dew).alias("rh_linear"))


@query("uv_from_speed_dir", "wind_u wind_v", """
    SELECT record_id, -wind_speed_10m * sin(radians(wind_direction_10m)) AS wind_u,
           -wind_speed_10m * cos(radians(wind_direction_10m)) AS wind_v FROM v_features""")
def _uv(t):
    u, v = meteo.wind_components(F.col("wind_speed_10m"), F.col("wind_direction_10m"))
    return t.v_features.select("record_id", u.alias("wind_u"), v.alias("wind_v"))


@query("reanalysis_daily_derive", "wind_speed wind_direction temperature_c rh_pct pressure_hpa precipitation_mm", """
    SELECT lat_cell, lon_cell, date, median(ws) AS wind_speed, median(wd) AS wind_direction, median(tc) AS temperature_c,
           median(rh) AS rh_pct, median(p) AS pressure_hpa, median(mm) AS precipitation_mm
    FROM (SELECT CAST(floor(latitude) AS BIGINT) AS lat_cell, CAST(floor(longitude) AS BIGINT) AS lon_cell,
                 strftime(timestamp_utc, '%Y-%m-%d') AS date,
                 sqrt(pow(u_component_of_wind_10m, 2) + pow(v_component_of_wind_10m, 2)) AS ws,
                 (degrees(atan2(u_component_of_wind_10m, v_component_of_wind_10m)) + 360) % 360 AS wd,
                 temperature_2m - 273.15 AS tc, 100 * exp((dewpoint_temperature_2m - temperature_2m) * (17.67::DOUBLE / 243.5)) AS rh,
                 surface_pressure / 100 AS p, total_precipitation * 1000 AS mm FROM v_weather)
    GROUP BY ALL""")
def _reanalysis(t):
    u, v = F.col("u_component_of_wind_10m"), F.col("v_component_of_wind_10m")
    names = ["wind_speed", "wind_direction", "temperature_c", "rh_pct", "pressure_hpa", "precipitation_mm"]
    derived = t.v_weather.select(
        F.floor("latitude").alias("lat_cell"), F.floor("longitude").alias("lon_cell"),
        F.to_date("timestamp_utc").cast("string").alias("date"), meteo.wind_speed(u, v).alias("wind_speed"),
        meteo.wind_toward(u, v).alias("wind_direction"), (F.col("temperature_2m") - 273.15).alias("temperature_c"),
        meteo.humidity_linear(F.col("temperature_2m"), F.col("dewpoint_temperature_2m")).alias("rh_pct"),
        (F.col("surface_pressure") / 100).alias("pressure_hpa"), (F.col("total_precipitation") * 1000).alias("precipitation_mm"))
    keys = ["lat_cell", "lon_cell", "date"]
    return exact_quantiles(derived, keys, names, [0.5]).select(*keys, *[F.col(f"{n}_p50").alias(n) for n in names])


def _static(t):
    return t.v_static.withColumns({"building_density": F.col("building_density") * 1.2,
                                   "distance_to_road_km": F.col("distance_to_road_km") - 3.0})


_STATIC = """SELECT location_id, land_use_class, latitude, longitude, building_density * 1.2::DOUBLE AS building_density, road_density,
    distance_to_road_km - 3.0 AS distance_to_road_km FROM v_static"""


@query("clean_static", "building_density road_density distance_to_road_km latitude longitude", f"""
    SELECT location_id, land_use_class, latitude, longitude,
           coalesce(least(greatest(building_density, 0), 100), 0) AS building_density,
           CASE WHEN road_density IS NULL THEN 0 ELSE least(greatest(road_density, 0), 50) END AS road_density,
           greatest(distance_to_road_km, 0) AS distance_to_road_km FROM ({_STATIC})""")
def _clean_static(t):
    return cleaning.clean_static(_static(t))


@query("impute_landuse", "", """
    SELECT location_id, coalesce(land_use_class, CASE WHEN building_density > 30 THEN 'Built-up' ELSE 'Cropland' END) AS land_use_class
    FROM v_static""")
def _landuse(t):
    return cleaning.impute_landuse(t.v_static).select("location_id", "land_use_class")


@query("landcover_label", "", "SELECT p_partkey, p_size * 5 AS land_use_class, CASE p_size * 5 "
       + " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.LAND_COVER.items()) + " END AS land_use_label FROM part")
def _landcover(t):
    return cleaning.landcover_label(t.part.select("p_partkey", (F.col("p_size") * 5).alias("land_use_class")))


_FLAGGED = ["aod_550nm", "satellite_no2", "satellite_so2", "satellite_co", "satellite_o3", "uv_aerosol_index",
            "boundary_layer_height", "temperature_2m", "relative_humidity_2m", "wind_speed_10m"]


@query("missing_flags", "", "SELECT record_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS is_{c}_missing" for c in _FLAGGED)
    + ", CASE WHEN aod_550nm IS NULL THEN 1 ELSE 0 END AS is_aod_missing, CASE WHEN satellite_no2 IS NULL THEN 1 ELSE 0 END AS is_no2_missing, "
      "0 AS is_so2_missing, 0 AS is_co_missing, 0 AS is_o3_missing FROM v_features")
def _flags(t):
    out = cleaning.short_gas_flags(cleaning.missing_flags(t.v_features))
    return out.select("record_id", *[c for c in out.columns if c.endswith("_missing")])


@query("grid_cell_key", "latitude longitude lat_cell lon_cell", """
    SELECT record_id, latitude, longitude, round_even(latitude, 2) AS lat_cell, round_even(longitude, 2) AS lon_cell,
           'cell_' || replace(CAST(round_even(latitude, 2) AS VARCHAR), '.', '') || '_'
           || replace(CAST(round_even(longitude, 2) AS VARCHAR), '.', '') AS location_key FROM v_pixels""")
def _cells(t):
    return cleaning.grid_cell_key(t.v_pixels.select("record_id", "latitude", "longitude"))


@query("round_to_hour", "", f"""
    SELECT event_id, {S.round_hour('ts')} AS hour_utc, {S.round_hour("(date_trunc('hour', ts) + INTERVAL 30 MINUTE)")} AS half_hour
    FROM events""")
def _round(t):
    half = F.date_trunc("hour", "ts") + F.expr("INTERVAL 30 MINUTES")
    return t.events.select("event_id", clock.round_to_hour(F.col("ts")).alias("hour_utc"), clock.round_to_hour(half).alias("half_hour"))


@query("local_time_parts", "", f"""
    SELECT event_id, l AS local_time, strftime(l, '%Y-%m-%d') AS local_date, CAST(hour(ts) AS INT) AS hour, CAST(month(ts) AS INT) AS month,
           CAST(dayofyear(ts) AS INT) AS doy, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring'
           WHEN month(ts) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season
    FROM (SELECT event_id, ts, {S.local('ts')} AS l FROM events)""")
def _local(t):
    local = clock.to_local(F.col("ts"))
    return t.events.select("event_id", local.alias("local_time"), F.to_date(local).cast("string").alias("local_date"),
                           F.hour("ts").alias("hour"), F.month("ts").alias("month"), F.dayofyear("ts").alias("doy"),
                           clock.season(F.month("ts")).alias("season"))


@query("overpass_window", "mean_value", f"""
    SELECT station_id, local_date, overpass, avg(value) AS mean_value, count(*) AS readings FROM (
      SELECT station_id, value, strftime(l, '%Y-%m-%d') AS local_date,
             CASE WHEN m BETWEEN 570 AND 690 THEN 'morning' WHEN m BETWEEN 750 AND 870 THEN 'afternoon' END AS overpass
      FROM (SELECT station_id, value, l, epoch_us(l) % 86400000000 / 60e6 AS m
            FROM (SELECT *, {S.local('timestamp_utc')} AS l FROM v_obs_long WHERE value BETWEEN 0 AND 1000)))
    WHERE overpass IS NOT NULL GROUP BY ALL""")
def _overpass(t):
    tagged = t.v_obs_long.filter(F.col("value").between(0, 1000)).withColumns({
        "overpass": clock.overpass(F.col("timestamp_utc")),
        "local_date": F.to_date(clock.to_local(F.col("timestamp_utc"))).cast("string")})
    return (tagged.filter(F.col("overpass").isNotNull()).groupBy("station_id", "local_date", "overpass")
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("readings")))

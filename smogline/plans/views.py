"""Air-quality shaped views over the test tables.

Each view is one SELECT that Spark and the checking SQL engine read alike; the
few functions they spell differently are written as upper-case macros.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

VIEWS = {
    # measuring stations spread over the region
    "v_stations": """
        SELECT s_suppkey AS station_id, s_name AS name, s_nationkey AS city_key,
               15.6e0 + ((s_suppkey * 37) % 651) / 100e0 AS latitude,
               72.6e0 + ((s_suppkey * 53) % 831) / 100e0 AS longitude
        FROM supplier""",
    # raw readings with sentinels and impossible values
    "v_obs_long": """
        SELECT event_id, user_id % 10 AS station_id, ts AS timestamp_utc,
               CASE event_type WHEN 'error' THEN 'pm25' WHEN 'click' THEN 'no2' WHEN 'view' THEN 'so2'
                               WHEN 'signup' THEN 'co' ELSE 'o3' END AS parameter,
               CASE WHEN event_id % 97 = 0 THEN -999e0 WHEN event_id % 101 = 0 THEN 5000e0
                    WHEN event_type = 'signup' THEN value / 10e0 ELSE value END AS value
        FROM events""",
    # station-hours, one column per pollutant
    "v_obs_hourly": """
        SELECT station_id, HOUR_OF(timestamp_utc) AS timestamp_utc,
               avg(CASE WHEN parameter = 'pm25' AND value BETWEEN 0 AND 1000 THEN value END) AS pm25,
               avg(CASE WHEN parameter = 'no2' AND value BETWEEN 0 AND 500 THEN value END) AS no2,
               avg(CASE WHEN parameter = 'so2' AND value BETWEEN 0 AND 500 THEN value END) AS so2,
               avg(CASE WHEN parameter = 'co' AND value BETWEEN 0 AND 50 THEN value END) AS co,
               avg(CASE WHEN parameter = 'o3' AND value BETWEEN 0 AND 500 THEN value END) AS o3
        FROM v_obs_long GROUP BY station_id, HOUR_OF(timestamp_utc)""",
    # valid PM2.5 readings, every reading of every station
    "v_pm25": """
        SELECT event_id, station_id, timestamp_utc, value AS pm25_ground
        FROM v_obs_long WHERE parameter = 'pm25' AND value BETWEEN 0 AND 1000""",
    # coarse values, so that equal runs occur
    "v_obs_flat": """
        SELECT event_id, user_id % 10 AS station_id, ts AS timestamp_utc,
               CAST(floor(value / 40e0) AS DOUBLE) AS pm25
        FROM events""",
    # satellite pixels
    "v_pixels": """
        SELECT o_orderkey AS record_id, o_orderdate AS timestamp_utc,
               15.6e0 + ((o_orderkey * 29) % 651) / 100e0 AS latitude,
               72.6e0 + ((o_orderkey * 41) % 831) / 100e0 AS longitude,
               o_totalprice / 90000e0 AS aod_550nm, CAST(o_orderkey % 4 AS INT) AS aod_qa_flag
        FROM orders""",
    # satellite and ground records on one clock; every event is on one of the sides
    "v_sat_events": """
        SELECT event_id AS record_id, user_id % 10 AS station_id, ts AS timestamp_utc, value / 60e0 AS aod_550nm
        FROM events WHERE event_type IN ('view', 'click')""",
    "v_ground_events": """
        SELECT event_id, user_id % 10 AS station_id, ts AS timestamp_utc, value AS pm25
        FROM events WHERE event_type NOT IN ('view', 'click')""",
    "v_sat_pixels": """
        SELECT event_id AS record_id, ts AS timestamp_utc,
               15.6e0 + ((event_id * 29) % 651) / 100e0 AS latitude,
               72.6e0 + ((event_id * 41) % 831) / 100e0 AS longitude, value / 60e0 AS aod_550nm
        FROM events WHERE event_type <> 'error'""",
    "v_ground_located": """
        SELECT g.event_id, g.station_id, g.timestamp_utc, g.pm25, s.latitude, s.longitude
        FROM v_ground_events g JOIN v_stations s ON g.station_id = s.station_id""",
    # raw weather rows
    "v_weather": """
        SELECT l_orderkey, l_linenumber, l_shipdate AS timestamp_utc,
               273.15e0 + l_quantity AS temperature_2m, 268.15e0 + l_quantity AS dewpoint_temperature_2m,
               l_quantity / 5e0 - 5e0 AS u_component_of_wind_10m, l_tax * 100e0 - 4e0 AS v_component_of_wind_10m,
               90000e0 + l_extendedprice / 10e0 AS surface_pressure, l_discount AS total_precipitation,
               l_extendedprice / 20e0 AS boundary_layer_height,
               15.6e0 + ((l_suppkey * 37) % 651) / 100e0 AS latitude,
               72.6e0 + ((l_suppkey * 53) % 831) / 100e0 AS longitude
        FROM lineitem""",
    # static geography with gaps
    "v_static": """
        SELECT p_partkey AS location_id, p_size * 2e0 AS building_density,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 40e0 END AS road_density,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS land_use_class,
               CAST(p_partkey % 13 AS DOUBLE) AS distance_to_road_km,
               15.6e0 + ((p_partkey * 37) % 651) / 100e0 AS latitude,
               72.6e0 + ((p_partkey * 53) % 831) / 100e0 AS longitude
        FROM part""",
    "v_districts": """
        SELECT n_nationkey AS id, n_name AS name, r_name AS region,
               15.6e0 + ((n_nationkey * 113) % 651) / 100e0 AS lat,
               72.6e0 + ((n_nationkey * 211) % 831) / 100e0 AS lon, 1 + n_nationkey % 3 AS tier
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # a fused training table: one row per order
    "v_features": """
        SELECT o_orderkey AS record_id, o_custkey % 23 AS station_id, o_custkey % 5 AS city_key,
               concat('cell_', CAST(o_custkey % 23 AS STRING)) AS location_id,
               o_orderdate + HOURS(o_orderkey % 24) AS timestamp_utc,
               15.6e0 + ((o_orderkey * 29) % 651) / 100e0 AS latitude,
               72.6e0 + ((o_orderkey * 41) % 831) / 100e0 AS longitude,
               ((o_orderkey * 43) % 700) / 10e0 AS distance_to_station_km,
               ((o_orderkey * 47) % 950) / 10e0 AS temporal_offset_minutes,
               CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice / 1000e0 END AS pm25_ground,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 90000e0 END AS aod_550nm,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 97) / 10e0 END AS satellite_no2,
               (o_custkey % 89) / 20e0 AS satellite_so2, (o_custkey % 83) / 30e0 AS satellite_co,
               (o_custkey % 79) / 90e0 AS satellite_o3, (o_custkey % 73) / 10e0 - 2e0 AS uv_aerosol_index,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 10e0 + ((o_orderkey * 7) % 300) / 10e0 END AS temperature_2m,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 20e0 + ((o_orderkey * 11) % 800) / 10e0 END
                   AS relative_humidity_2m,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE ((o_orderkey * 13) % 150) / 10e0 END AS wind_speed_10m,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE ((o_orderkey * 17) % 3600) / 10e0 END AS wind_direction_10m,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 50e0 + (o_orderkey * 19) % 3000 END AS boundary_layer_height,
               850e0 + ((o_orderkey * 23) % 2000) / 10e0 AS surface_pressure,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE ((o_orderkey * 3) % 40) / 10e0 END AS precipitation_1h,
               ((o_custkey * 31) % 300) / 10e0 AS road_density, ((o_custkey * 37) % 1000) / 10e0 AS building_density,
               CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE (o_custkey * 3) % 900 + 0e0 END AS elevation_m,
               (o_custkey * 61) % 9000 + 0e0 AS population_density, ((o_custkey * 7) % 120) / 10e0 AS distance_to_road_km,
               ((o_custkey * 13) % 250) / 10e0 AS distance_to_industry_km
        FROM orders""",
}

_MACROS = {
    "spark": {r"HOUR_OF\(([^()]*)\)": r"CAST(date_trunc('HOUR', \1) AS TIMESTAMP_NTZ)",
              r"HOURS\(([^()]*)\)": r"make_dt_interval(0, CAST(\1 AS INT))"},
    "check": {r"HOUR_OF\(([^()]*)\)": r"date_trunc('hour', \1)", r"HOURS\(([^()]*)\)": r"to_hours(\1)",
              r"AS STRING": "AS VARCHAR"},
}


def _expand(text: str, dialect: str) -> str:
    for pattern, replacement in _MACROS[dialect].items():
        text = re.sub(pattern, replacement, text)
    return text


def _mentions(text: str, names) -> list[str]:
    words = set(re.findall(r"\b\w+\b", text))
    return [n for n in names if n in words]


def with_views(sql: str) -> str:
    """The query text preceded by the definitions of the views it uses."""
    needed: list[str] = []

    def add(text):
        for name in _mentions(text, VIEWS):
            if name not in needed:
                add(VIEWS[name])
                needed.append(name)
    add(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({_expand(VIEWS[n], 'check')})" for n in needed)
    return f"WITH {heads} SELECT * FROM ({sql})"


class Tables:
    """Base tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            if name in BASE_TABLES:
                made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                inputs = _mentions(text, [*BASE_TABLES, *VIEWS])
                sql = _expand(text, "spark")
                for n in inputs:
                    sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
                made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in inputs if f"{{{n}}}" in sql})
            else:
                raise AttributeError(name)
        return made[name]

"""Queries of scans, gates, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.operators import cleaning, quality
from smogline.plans.registry import query
from smogline.session import work_folder
from smogline.sources import nested, readers, sinks


@query("scan_parquet_union", "supplier_balance customer_balance", """
    SELECT count(*) AS row_count, count(s_suppkey) AS suppliers, count(c_custkey) AS customers,
           count(c_mktsegment) AS segments, sum(s_acctbal) AS supplier_balance, sum(c_acctbal) AS customer_balance
    FROM (SELECT * FROM supplier UNION ALL BY NAME SELECT * FROM customer)""")
def _scan(t):
    both = readers.scan_parquet_union(t.spark, [f"{t.folder}/supplier.parquet", f"{t.folder}/customer.parquet"])
    return both.agg(F.count(F.lit(1)).alias("row_count"), F.count("s_suppkey").alias("suppliers"),
                    F.count("c_custkey").alias("customers"), F.count("c_mktsegment").alias("segments"),
                    F.sum("s_acctbal").alias("supplier_balance"), F.sum("c_acctbal").alias("customer_balance"))


@query("scan_csv_features", "road_density building_density latitude", """
    SELECT location_id, road_density, building_density, land_use_class, latitude FROM v_static""")
def _csv(t):
    path = work_folder(t.spark, "csv")
    (t.v_static.select("location_id", "road_density", "building_density", "land_use_class", "latitude")
     .write.option("header", True).csv(path))
    return readers.scan_csv_features(t.spark, path, "location_id bigint, road_density double, building_density double, "
                                     "land_use_class string, latitude double")


@query("flatten_measurements", "value", """
    SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS value, ts AS timestamp_utc FROM events
    UNION ALL SELECT event_id, NULL, ts FROM events""")
def _measurements(t):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.concat(F.lit('{"results":[{"value":'), F.get_json_object("props", "$.k"),
                    F.lit(',"period":{"datetimeFrom":{"utc":"'), iso, F.lit('"}}},{"value":"n/a","datetime":"'), iso,
                    F.lit('"}]}'))
    return nested.flatten_measurements(t.events.withColumn("body", body), "body", ["event_id"])


@query("flatten_stations", "latitude longitude", """
    SELECT CAST(station_id AS VARCHAR) AS station_id, name AS station_name,
           CASE WHEN station_id % 3 = 0 THEN 'Pune' ELSE 'C' || city_key END AS city,
           CASE WHEN station_id % 2 = 0 THEN 'IN' ELSE 'XX' END AS country, CAST(NULL AS VARCHAR) AS provider,
           latitude, CASE WHEN station_id % 5 = 0 THEN NULL ELSE longitude END AS longitude,
           CAST(NULL AS VARCHAR) AS first_seen, '2024-01-' || lpad(CAST(1 + station_id % 28 AS VARCHAR), 2, '0') AS last_seen
    FROM v_stations""")
def _stations(t):
    s = F.col("station_id")
    record = F.struct(
        s.alias("id"), F.col("name"), F.when(s % 3 != 0, F.concat(F.lit("C"), F.col("city_key"))).alias("city"),
        F.when(s % 2 != 0, F.struct(F.lit("XX").alias("code"))).alias("country"),
        F.struct("latitude", F.when(s % 5 != 0, F.col("longitude")).alias("longitude")).alias("coordinates"),
        F.struct(F.concat(F.lit("2024-01-"), F.lpad((1 + s % 28).cast("string"), 2, "0")).alias("utc")).alias("datetimeLast"))
    body = F.to_json(F.struct(F.array(record).alias("results")))
    return nested.flatten_stations(t.v_stations.select(body.alias("body")), "body")


def _raw(t):
    """Pixels as raw readings with unreadable times and missing values."""
    key = F.col("record_id")
    return t.v_pixels.select(
        key, "latitude", "longitude",
        F.when(key % 19 == 0, "not a time").otherwise(F.col("timestamp_utc").cast("string")).alias("timestamp_utc"),
        F.when(key % 23 != 0, F.col("aod_550nm")).alias("value"))


_RAW_SQL = """SELECT record_id, latitude, longitude,
    CASE WHEN record_id % 19 = 0 THEN 'not a time' ELSE CAST(timestamp_utc AS VARCHAR) END AS timestamp_utc,
    CASE WHEN record_id % 23 = 0 THEN NULL ELSE aod_550nm END AS value FROM v_pixels"""


@query("raw_gate", "latitude longitude value", f"""
    SELECT record_id, latitude, longitude, TRY_CAST(timestamp_utc AS TIMESTAMP) AS timestamp_utc, value FROM ({_RAW_SQL})
    WHERE latitude BETWEEN 17.5 AND 19.5 AND longitude BETWEEN 73 AND 75
      AND TRY_CAST(timestamp_utc AS TIMESTAMP) IS NOT NULL AND value IS NOT NULL""")
def _gate(t):
    return cleaning.raw_gate(_raw(t))


@query("raw_gate_counts", "", f"""
    SELECT count(*) AS rows_before, count(*) FILTER (p AND c AND v) AS rows_after,
           count(*) FILTER (NOT p) AS bad_coordinates, count(*) FILTER (NOT c) AS bad_timestamps,
           count(*) FILTER (NOT v) AS missing_values
    FROM (SELECT latitude BETWEEN 17.5 AND 19.5 AND longitude BETWEEN 73 AND 75 AS p,
                 TRY_CAST(timestamp_utc AS TIMESTAMP) IS NOT NULL AS c, value IS NOT NULL AS v FROM ({_RAW_SQL}))""")
def _gate_counts(t):
    return cleaning.raw_gate_counts(_raw(t))


@query("bbox_date_filter", "latitude longitude aod_550nm", """
    SELECT * FROM v_pixels WHERE timestamp_utc >= TIMESTAMP '1996-01-01' AND timestamp_utc < TIMESTAMP '1999-01-01'
      AND latitude BETWEEN 18.0 AND 20.5 AND longitude BETWEEN 73.0 AND 77.0""")
def _bbox(t):
    return readers.bbox_date_filter(t.v_pixels, "1996-01-01", "1999-01-01",
                                    {"lat_min": 18.0, "lat_max": 20.5, "lon_min": 73.0, "lon_max": 77.0})


@query("sink_daily_parquet", "mean_value", """
    SELECT CAST(CAST(timestamp_utc AS DATE) AS VARCHAR) AS date, count(*) AS readings, avg(value) AS mean_value
    FROM v_obs_long GROUP BY 1""")
def _daily(t):
    path = work_folder(t.spark, "daily")
    sinks.daily_parquet(t.v_obs_long, path)
    return (t.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"))
            .agg(F.count(F.lit(1)).alias("readings"), F.avg("value").alias("mean_value")))


@query("provenance_manifest", "latitude_min latitude_max longitude_min longitude_max", """
    SELECT CAST(CAST(timestamp_utc AS DATE) AS VARCHAR) AS date, count(*) AS row_count,
           string_agg(DISTINCT parameter, ',' ORDER BY parameter) AS parameters,
           count(DISTINCT o.station_id) AS station_count, min(latitude) AS latitude_min, max(latitude) AS latitude_max,
           min(longitude) AS longitude_min, max(longitude) AS longitude_max,
           'station_id,event_id,timestamp_utc,parameter,value,latitude,longitude,date' AS columns,
           '1.0.0' AS schema_version
    FROM v_obs_long o JOIN v_stations s ON o.station_id = s.station_id GROUP BY 1""")
def _provenance(t):
    located = t.v_obs_long.join(t.v_stations.select("station_id", "latitude", "longitude"), "station_id")
    return quality.provenance_manifest(located.withColumn("date", F.to_date("timestamp_utc").cast("string")), ["date"])


@query("canonical_manifest", " ".join(f"missing_{c}_pct" for c in quality.MANIFEST_COLUMNS), "SELECT count(*) AS rows, 29 AS columns, "
       + ", ".join(f"round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_{c}_pct"
                   for c in quality.MANIFEST_COLUMNS) + " FROM v_features")
def _canonical(t):
    return quality.canonical_manifest(t.v_features)


@query("sink_geojson", "longitude latitude value uncertainty reliability", """
    SELECT 'Feature' AS type, longitude, latitude, CAST(station_id AS VARCHAR) AS grid_id, coalesce(m, 0.0) AS value,
           12.5::DOUBLE AS uncertainty, 85.0::DOUBLE AS reliability
    FROM v_stations LEFT JOIN (SELECT station_id, avg(pm25_ground) AS m FROM v_pm25 GROUP BY 1) USING (station_id)""")
def _geojson(t):
    path = work_folder(t.spark, "geojson")
    means = t.v_pm25.groupBy("station_id").agg(F.avg("pm25_ground").alias("pm25_pred"))
    sinks.geojson_lines(t.v_stations.join(means, "station_id", "left").withColumn("grid_id", F.col("station_id")), path)
    feature = F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, "
                          "properties struct<grid_id:string,value:double,pm25:double,uncertainty:double,reliability:double>")
    return t.spark.read.text(path).select(feature.alias("f")).select(
        "f.type", F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"),
        "f.properties.grid_id", "f.properties.value", "f.properties.uncertainty", "f.properties.reliability")


@query("recent_stations", "", """
    SELECT station_id, max(timestamp_utc) AS last_seen FROM v_obs_long GROUP BY 1 ORDER BY 2 DESC, 1""")
def _recent(t):
    seen = t.v_obs_long.groupBy("station_id").agg(F.max("timestamp_utc").alias("last_seen"))
    return nested.recent_stations(seen, "last_seen", ["station_id"])


_BATCHES = ("pm25", "no2", "so2", "co", "o3")


@query("concat_batches", "value", " UNION ALL ".join(f"""
    SELECT event_id, {"station_id" if p == "pm25" else "NULL"} AS station_id, '{p}' AS species, value FROM v_obs_long WHERE parameter = '{p}'""" for p in _BATCHES))
def _concat(t):
    def batch(p):       # only the first batch knows its stations
        return t.v_obs_long.filter(F.col("parameter") == p).select("event_id", *["station_id"] * (p == "pm25"), F.lit(p).alias("species"), "value")
    return quality.concat_batches([batch(p) for p in _BATCHES])


@query("drop_exact_duplicates", "", """
    SELECT count(*) AS rows_after, any_value(n) AS rows_before
    FROM (SELECT DISTINCT station_id, parameter, date_trunc('hour', timestamp_utc) AS h FROM v_obs_long),
         (SELECT count(*) AS n FROM v_obs_long)""")
def _distinct(t):
    slim = t.v_obs_long.select("station_id", "parameter", F.date_trunc("hour", "timestamp_utc").alias("h"))
    before = slim.agg(F.count(F.lit(1)).alias("n"))
    return quality.drop_exact_duplicates(slim).agg(F.count(F.lit(1)).alias("rows_after")).select(
        "rows_after", before.scalar().alias("rows_before"))


@query("quality_rules", "", f"""
    WITH x AS (SELECT * FROM v_features), r AS (
      SELECT 'min_rows' AS rule, greatest(1000 - count(*), 0) AS bad_rows, count(*) >= 1000 AS passed FROM x
      UNION ALL SELECT 'required_columns', 2, false
      UNION ALL SELECT 'forbidden_columns', 0, true
      UNION ALL SELECT 'latitude_bounds', count(*) FILTER (NOT latitude BETWEEN 18 AND 19), count(*) FILTER (NOT latitude BETWEEN 18 AND 19) = 0 FROM x
      UNION ALL SELECT 'longitude_bounds', count(*) FILTER (NOT longitude BETWEEN 73 AND 75), count(*) FILTER (NOT longitude BETWEEN 73 AND 75) = 0 FROM x
      UNION ALL SELECT 'timestamp_readable', count(*) FILTER (timestamp_utc IS NULL), count(*) FILTER (timestamp_utc IS NULL) = 0 FROM x
      UNION ALL SELECT 'target_null_share', count(*) FILTER (pm25_ground IS NULL), count(*) FILTER (pm25_ground IS NULL) <= count(*) * 0.5 FROM x
      {' '.join(f"UNION ALL SELECT '{c}_bounds', count(*) FILTER (NOT {c} BETWEEN {lo} AND {hi}), count(*) FILTER (NOT {c} BETWEEN {lo} AND {hi}) = 0 FROM x" for c, (lo, hi) in K.CANONICAL_BOUNDS.items())}
      UNION ALL SELECT 'temporal_offset', count(*) FILTER (abs(temporal_offset_minutes) > 90), count(*) FILTER (abs(temporal_offset_minutes) > 90) = 0 FROM x
      UNION ALL SELECT 'duplicates', (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)),
                       (SELECT count(*) FROM x) = (SELECT count(*) FROM (SELECT DISTINCT * FROM x)))
    SELECT rule, CAST(bad_rows AS BIGINT) AS bad_rows, passed FROM r""")
def _rules(t):
    return quality.quality_rules(t.v_features)


@query("stage_funnel", "missing_pct", """
    SELECT 0 AS position, 'raw_ground' AS stage, count(*) AS rows, CAST(NULL AS DOUBLE) AS missing_pct,
           CAST(0 AS BIGINT) AS invalid_coords, count(*) > 1000 AS ready FROM v_obs_long
    UNION ALL SELECT 1, 'satellite', count(*), avg(CASE WHEN aod_550nm IS NULL THEN 1.0 ELSE 0 END) * 100, 0, count(*) > 1000
      FROM (SELECT CASE WHEN aod_qa_flag >= 2 AND aod_550nm BETWEEN 0 AND 5 THEN aod_550nm END AS aod_550nm FROM v_pixels)
    UNION ALL SELECT 2, 'canonical', count(*), (avg(CASE WHEN aod_550nm IS NULL THEN 1.0 ELSE 0 END)
           + avg(CASE WHEN satellite_no2 IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN temperature_2m IS NULL THEN 1.0 ELSE 0 END)) / 3 * 100,
           0, count(*) > 1000 FROM v_features""")
def _funnel(t):
    return quality.stage_funnel(
        {"raw_ground": t.v_obs_long, "satellite": cleaning.clean_aod(t.v_pixels), "canonical": t.v_features},
        {"satellite": ["aod_550nm"], "canonical": ["aod_550nm", "satellite_no2", "temperature_2m"]}, ready_rows=1000)

"""Queries of joins in space, time and by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline.functions import clock
from smogline.operators import advisory, matching
from smogline.plans import sqltext as S
from smogline.plans.registry import query

_KM = S.haversine("p.latitude", "p.longitude", "s.latitude", "s.longitude")


def nearest_sql(pixels: str, stations: str, radius: float) -> str:
    return f"""
      SELECT p.*, n.station_id, n.km AS distance_to_station_km FROM {pixels} p LEFT JOIN (
        SELECT record_id, station_id, km FROM (
          SELECT p.record_id, s.station_id, {_KM} AS km FROM {pixels} p JOIN {stations} s
            ON abs(p.latitude - s.latitude) < {radius / 110.0})
        WHERE km <= {radius}
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round(km, 6), station_id) = 1) n
      ON p.record_id = n.record_id"""


@query("nearest_station_within", "latitude longitude aod_550nm distance_to_station_km",
       nearest_sql("v_pixels", "v_stations", 25.0))
def _nearest(t):
    return matching.nearest_station_within(t.v_pixels, t.v_stations)


@query("haversine_matrix", "distance_km", f"""
    SELECT station_id, location_id, km AS distance_km FROM (
      SELECT s.station_id, p.location_id, {_KM} AS km FROM v_stations s JOIN v_static p ON abs(p.latitude - s.latitude) < 0.2)
    WHERE km <= 15""")
def _haversine(t):
    return matching.haversine_matrix(t.v_static, t.v_stations, 15.0, "location_id", "station_id").select(
        "station_id", "location_id", "distance_km")


def temporal_sql(sat: str, ground: str, window: float) -> str:
    off = "abs(epoch_us(s.timestamp_utc) - epoch_us(g.timestamp_utc)) / 60e6"
    return f"""
      SELECT s.*, g.pm25, g.timestamp_utc AS ground_timestamp, {off} AS temporal_offset_minutes
      FROM {sat} s JOIN {ground} g ON s.station_id = g.station_id
       AND g.timestamp_utc BETWEEN s.timestamp_utc - INTERVAL {int(window)} MINUTE AND s.timestamp_utc + INTERVAL {int(window)} MINUTE
      QUALIFY row_number() OVER (PARTITION BY s.record_id ORDER BY {off}, g.timestamp_utc, g.pm25) = 1"""


@query("temporal_window_match", "aod_550nm pm25 temporal_offset_minutes",
       temporal_sql("v_sat_events", "v_ground_events", 60))
def _temporal(t):
    return matching.temporal_window_match(t.v_sat_events, t.v_ground_events, ["pm25"])


_SEEN = "v_stations_seen AS (SELECT station_id, min(latitude) AS latitude, min(longitude) AS longitude FROM v_ground_located GROUP BY 1)"


@query("collocate", "latitude longitude aod_550nm distance_to_station_km pm25 temporal_offset_minutes", f"""
    WITH {_SEEN}, placed AS (SELECT * FROM ({nearest_sql("v_sat_pixels", "v_stations_seen", 25.0)}) WHERE station_id IS NOT NULL)
    {temporal_sql("placed", "v_ground_located", 60)}""")
def _collocate(t):
    return matching.collocate(t.v_sat_pixels, t.v_ground_located, ["pm25"])


def _sweep_sql() -> str:
    arms = " UNION ALL ".join(f"""
      SELECT '{n}' AS config, {r}::DOUBLE AS spatial_radius_km, {w}::DOUBLE AS time_window_min,
             (SELECT count(*) FROM placed WHERE distance_to_station_km <= {r}) AS spatial_matched,
             (SELECT count(*) FROM paired WHERE distance_to_station_km <= {r} AND temporal_offset_minutes <= {w}) AS collocated_pairs"""
                              for n, r, w in matching.SWEEP)
    return f"""WITH {_SEEN},
      placed AS (SELECT * FROM ({nearest_sql("v_sat_pixels", "v_stations_seen", 50.0)}) WHERE station_id IS NOT NULL),
      paired AS ({temporal_sql("placed", "v_ground_located", 90)}) {arms}"""


@query("matching_sweep", "spatial_radius_km time_window_min", _sweep_sql())
def _sweep(t):
    return matching.matching_sweep(t.v_sat_pixels, t.v_ground_located)


_WX = ["temperature_2m", "boundary_layer_height", "surface_pressure"]


@query("weather_cell_join", "latitude longitude building_density temperature_2m boundary_layer_height surface_pressure", f"""
    WITH w AS (SELECT {S.round_hour('timestamp_utc')} AS h, round_even(latitude, 2) AS a, round_even(longitude, 2) AS o,
                      {', '.join(f'avg({c}) AS {c}' for c in _WX)} FROM v_weather GROUP BY ALL),
         d AS (SELECT location_id, latitude, longitude, building_density,
                      TIMESTAMP '1995-01-01' + to_days(CAST(location_id % 2000 AS INTEGER)) AS timestamp_utc FROM v_static)
    SELECT d.*, {', '.join(_WX)} FROM d LEFT JOIN w ON h = {S.round_hour('d.timestamp_utc')}
       AND a = round_even(d.latitude, 2) AND o = round_even(d.longitude, 2)""")
def _weather_join(t):
    day = F.lit("1995-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(location_id % 2000 AS INT))")
    places = t.v_static.select("location_id", "latitude", "longitude", "building_density", day.alias("timestamp_utc"))
    return matching.weather_cell_join(places, t.v_weather.select("timestamp_utc", "latitude", "longitude", *_WX))


@query("static_cell_join", "latitude longitude aod_550nm road_density building_density distance_to_road_km", """
    WITH s AS (SELECT round_even(latitude, 2) AS a, round_even(longitude, 2) AS o, road_density, building_density, land_use_class,
                      distance_to_road_km FROM v_static
               QUALIFY row_number() OVER (PARTITION BY round_even(latitude, 2), round_even(longitude, 2) ORDER BY location_id) = 1)
    SELECT p.*, road_density, building_density, land_use_class, distance_to_road_km
    FROM v_pixels p LEFT JOIN s ON a = round_even(p.latitude, 2) AND o = round_even(p.longitude, 2)""")
def _static_join(t):
    return matching.static_cell_join(t.v_pixels, t.v_static, ["location_id"])


_SPECIES = ("pm25", "no2", "so2", "co", "o3")


@query("species_outer_join", " ".join(_SPECIES), "WITH " + ", ".join(f"""
    t_{p} AS (SELECT station_id, date_trunc('hour', timestamp_utc) AS hour, avg(value) AS {p} FROM v_obs_long WHERE parameter = '{p}' GROUP BY ALL)""" for p in _SPECIES)
       + f" SELECT station_id, hour, {', '.join(_SPECIES)} FROM t_pm25 " + " ".join(f"FULL JOIN t_{p} USING (station_id, hour)" for p in _SPECIES[1:]))
def _species(t):
    def one(p):
        hour = clock.trunc_hour(F.col("timestamp_utc")).alias("hour")
        return t.v_obs_long.filter(F.col("parameter") == p).groupBy("station_id", hour).agg(F.avg("value").alias(p))
    return matching.species_outer_join([one(p) for p in _SPECIES], ["station_id", "hour"])


@query("daily_weather_join", "pm25 temperature precipitation", """
    SELECT date, pm25, temperature, precipitation FROM
      (SELECT strftime(timestamp_utc, '%Y-%m-%d') AS date, avg(pm25_ground) AS pm25 FROM v_features GROUP BY 1)
      JOIN (SELECT strftime(timestamp_utc, '%Y-%m-%d') AS date, avg(temperature_2m) AS temperature, sum(total_precipitation) AS precipitation
            FROM v_weather GROUP BY 1) USING (date)""")
def _daily_join(t):
    date = F.to_date("timestamp_utc").cast("string").alias("date")
    daily = t.v_features.groupBy(date).agg(F.avg("pm25_ground").alias("pm25"))
    weather = t.v_weather.groupBy(date).agg(F.avg("temperature_2m").alias("temperature"),
                                            F.sum("total_precipitation").alias("precipitation"))
    return matching.daily_weather_join(daily, weather)


@query("station_metadata_fill", "latitude longitude value", """
    SELECT e.event_id, e.station_id, CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'feed' END AS raw_name,
           coalesce(CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'feed' END, s.name) AS station_name,
           coalesce(CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE 18.5 END, s.latitude) AS latitude,
           coalesce(CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE 73.8 END, s.longitude) AS longitude, e.value
    FROM v_obs_long e LEFT JOIN v_stations s USING (station_id)""")
def _metadata(t):
    e = F.col("event_id")
    feed = t.v_obs_long.select("event_id", "station_id", F.when(e % 3 != 0, "feed").alias("raw_name"),
                               F.when(e % 3 != 0, "feed").alias("station_name"),
                               F.when(e % 4 != 0, 18.5).alias("latitude"), F.when(e % 4 != 0, 73.8).alias("longitude"), "value")
    return matching.station_metadata_fill(feed, t.v_stations.withColumnRenamed("name", "station_name"))


_FLAT = S.flat("p.latitude", "p.longitude", "l.lat", "l.lon")
_TOWNS = """SELECT 1000 + s.station_id AS id, s.name, CAST(NULL AS VARCHAR) AS region, s.latitude AS lat, s.longitude AS lon, 3 AS tier, false AS is_district_hq, 1 AS list FROM v_stations s"""


@query("nearest_reference_point", "latitude longitude distance_km", f"""
    WITH l AS (SELECT id, name, region, lat, lon, tier, true AS is_district_hq, 0 AS list FROM v_districts UNION ALL {_TOWNS})
    SELECT location_id, latitude, longitude, place, tier, is_district_hq, {S.bround('km', 2)} AS distance_km FROM (
      SELECT location_id, p.latitude, p.longitude, l.name AS place, l.tier, l.is_district_hq, round({_FLAT}, 6) AS km
      FROM v_static p, l
      QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY round({_FLAT}, 6), list, id) = 1)""")
def _reference(t):
    towns = t.v_stations.select((F.col("station_id") + 1000).alias("id"), "name", F.col("latitude").alias("lat"),
                                F.col("longitude").alias("lon"))
    everywhere = matching.all_locations(t.v_districts, towns).withColumnRenamed("name", "place")
    points = t.v_static.select("location_id", "latitude", "longitude")
    return matching.nearest_reference_point(points, everywhere, ["place", "tier", "is_district_hq"], ["_list", "id"])


_ROAD = S.haversine("g.latitude", "g.longitude", "f.latitude", "f.longitude")


@query("proximity_aggregate", "latitude longitude length_km covered_pct nearest_km", f"""
    WITH f AS (SELECT latitude, longitude, p_len AS length_km, p_area AS area_km2 FROM
                 (SELECT latitude, longitude, aod_550nm AS p_len, aod_550nm / 20 AS p_area FROM v_pixels)),
         n AS (SELECT g.location_id, count(*) AS features, sum(f.length_km) AS length_km, sum(f.area_km2) / (pi() * 4) * 100 AS covered_pct,
                      min({_ROAD}) AS nearest_km
               FROM v_static g JOIN f ON abs(g.latitude - f.latitude) < 0.03 WHERE {_ROAD} <= 2 GROUP BY 1)
    SELECT g.location_id, g.latitude, g.longitude, coalesce(features, 0) AS features, coalesce(length_km, 0) AS length_km,
           coalesce(covered_pct, 0) AS covered_pct, nearest_km FROM v_static g LEFT JOIN n USING (location_id)""")
def _proximity(t):
    features = t.v_pixels.select("latitude", "longitude", F.col("aod_550nm").alias("length_km"),
                                 (F.col("aod_550nm") / 20).alias("area_km2"))
    return matching.proximity_aggregate(t.v_static.select("location_id", "latitude", "longitude"), features, "location_id", 2.0)


# languages of the points by id; the last one is unknown, and one template is left out, so that both fall back to English
LANGUAGES = ("en", "mr", "hi", "fr")
UNTRANSLATED = ("hi", "Poor")


def _local_names() -> str:
    arms = " ".join(f"WHEN lang = '{code}' AND c.category = '{k}' THEN '{v}'" for code, names in advisory.K.CATEGORY_NAMES_LOCAL.items() for k, v in names.items())
    return f"CASE {arms} END"


def _template_values() -> str:
    rows = ", ".join("('" + language + "', '" + c + "', " + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + ")"
                     for language, table in advisory.TEXTS.items() for c, texts in table.items() if (language, c) != UNTRANSLATED)
    return f"(VALUES {rows}) AS tpl({', '.join(advisory.TEMPLATE_COLUMNS)})"


_ADV_KM = S.flat("p.latitude", "p.longitude", "d.lat", "d.lon")


@query("advisory_lookup", "distance_km aqi_rounded", f"""
    WITH p AS (SELECT record_id, latitude, longitude, aod_550nm * 90 AS aqi, CASE record_id % 4 WHEN 1 THEN 'mr' WHEN 2 THEN 'hi' ELSE 'en' END AS lang FROM v_pixels),
         c AS (SELECT *, {S.category('aqi')} AS category FROM p),
         n AS (SELECT p.record_id, d.name AS district, d.region, round({_ADV_KM}, 6) AS km FROM c p, v_districts d
               QUALIFY row_number() OVER (PARTITION BY p.record_id ORDER BY round({_ADV_KM}, 6), d.id) = 1)
    SELECT record_id, lang AS language, c.category, {_local_names()} AS category_localized,
           CASE c.category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in advisory.K.ADVISORY_COLORS.items())} END AS color,
           district, {S.bround('km', 2)} AS distance_km, headline, summary, mask, ventilation, general, sensitive, farmer, traffic_worker, outdoor_worker, schools,
           CASE WHEN region = 'ASIA' OR lang <> 'en' THEN '' ELSE 'Regional note for ' || region END AS regional_note,
           {S.bround('aqi')} AS aqi_rounded
    FROM c JOIN n USING (record_id) JOIN {_template_values()} ON tpl.category = c.category AND tpl.language = CASE WHEN lang = '{UNTRANSLATED[0]}' AND c.category = '{UNTRANSLATED[1]}' THEN 'en' ELSE lang END""")
def _advisory(t):
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.pmod("record_id", F.lit(4)) + 1).cast("int"))
    points = t.v_pixels.select("record_id", "latitude", "longitude", (F.col("aod_550nm") * 90).alias("aqi"), language.alias("language"))
    notes = t.region.filter("r_name <> 'ASIA'").select(
        F.col("r_name").alias("region"), F.lit("en").alias("language"), F.concat(F.lit("Regional note for "), F.col("r_name")).alias("note"))
    templates = advisory.default_templates(t.spark).filter((F.col("language") != UNTRANSLATED[0]) | (F.col("category") != UNTRANSLATED[1]))
    out = advisory.advisory_lookup(points, templates, t.v_districts, notes)
    return out.select("record_id", "language", "category", "category_localized", "color", "district", "distance_km", "headline", "summary", "mask",
                      "ventilation", *advisory.PERSONAS, "regional_note", "aqi_rounded")


@query("location_search", "", """
    SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')""")
def _search(t):
    return matching.location_search(t.part.select("p_partkey", "p_name", "p_type"), "  RED ", ["p_name", "p_type"])


@query("location_suggest", "", """
    SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY p_name, p_partkey LIMIT 8""")
def _suggest(t):
    # the search box shows the eight first hits
    return matching.location_search(t.part.select("p_partkey", "p_name"), "bolt", ["p_name"]).orderBy("p_name", "p_partkey").limit(8)


@query("satellite_carry_forward", "pm25 aod_550nm satellite_age_hours", """
    SELECT g.event_id, g.station_id, g.timestamp_utc, g.pm25, s.aod_550nm,
           (epoch_us(g.timestamp_utc) - epoch_us(s.timestamp_utc)) / 3600e6 AS satellite_age_hours
    FROM v_ground_events g ASOF LEFT JOIN v_sat_events s ON g.station_id = s.station_id AND g.timestamp_utc >= s.timestamp_utc""")
def _carry(t):
    return matching.satellite_carry_forward(t.v_ground_events, t.v_sat_events, ["station_id"], ["aod_550nm"], times_id=["event_id"])


@query("distinct_stations", "latitude longitude", """
    SELECT station_id, min(latitude) AS latitude, arg_min(longitude, latitude) AS longitude FROM v_ground_located GROUP BY 1""")
def _stations(t):
    return matching.distinct_stations(t.v_ground_located)


@query("dedupe_closest", "value offset_minutes", """
    SELECT station_id, hour, event_id, value, offset_minutes FROM (
      SELECT station_id, date_trunc('hour', timestamp_utc) AS hour, event_id, value,
             abs(epoch_us(timestamp_utc) - epoch_us(date_trunc('hour', timestamp_utc)) - 1800000000) / 60e6 AS offset_minutes FROM v_obs_long)
    QUALIFY row_number() OVER (PARTITION BY station_id, hour ORDER BY offset_minutes, event_id) = 1""")
def _dedupe(t):
    hour = clock.trunc_hour(F.col("timestamp_utc"))
    offset = F.abs(clock.micros(F.col("timestamp_utc")) - clock.micros(hour) - F.lit(1_800_000_000)) / 60e6
    rows = t.v_obs_long.select("station_id", hour.alias("hour"), "event_id", "value", offset.alias("offset_minutes"))
    return matching.dedupe_closest(rows, ["station_id", "hour"], ["offset_minutes", "event_id"])

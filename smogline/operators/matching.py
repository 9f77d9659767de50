"""Joins in space and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline import constants as K
from smogline.functions import aqi, clock, geo
from smogline.functions.geo import ProximityCells
from smogline.operators import nearest, series
from smogline.operators.common import count_if, present, with_row_of
from smogline.session import materialise


def distinct_stations(df: DataFrame, key="station_id", lat="latitude", lon="longitude",
                      order=("latitude", "longitude")) -> DataFrame:
    """One located row per station: the first by ``order``."""
    located = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return (located.groupBy(key)
            .agg(F.min_by(F.struct(lat, lon), F.struct(*order)).alias("_s"))
            .select(key, F.col(f"_s.{lat}").alias(lat), F.col(f"_s.{lon}").alias(lon)))


def nearest_station_within(pixels: DataFrame, stations: DataFrame, radius_km: float = 25.0) -> DataFrame:
    """Nearest station within the radius of every pixel; pixels without one keep nulls."""
    return nearest.nearest_within(pixels, stations, radius_km, ["station_id"], ["station_id"],
                                  distance_name="distance_to_station_km")


# Rows of either side that meet in one piece of a cell, and pairs that one task compares, about.
PIECE_ROWS = 2_000
PAIRS_PER_TASK = 8_000_000
MAX_TASKS = 20_000


def haversine_matrix(a: DataFrame, b: DataFrame, radius_km: float, a_id: str, b_id: str, piece_rows: int = PIECE_ROWS,
                     pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Great-circle distances between the points of two tables that lie within
    ``radius_km`` of each other (a sparse distance matrix).

    The pairs, not the rows, are the work: the rows of either side of a cell are dealt to pieces of about ``piece_rows``, every piece of one
    side meets every piece of the other, and there are as many tasks as the pairs need.  So neither a dense cell nor a few small files
    hold the work of one task.
    """
    cells = ProximityCells(radius_km)
    left = a.select(F.col(a_id), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo")).withColumn(
        "_cell", cells.home(F.col("_la"), F.col("_lo"))).filter(F.col("_cell").isNotNull())
    right = cells.spread(b.select(F.col(b_id), F.col("latitude").alias("_lb"), F.col("longitude").alias("_lp")), "_lb", "_lp").filter(F.col("_cell").isNotNull())
    sizes = materialise(left.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m")), "_cell")
                        .select("_cell", "_n", "_m", F.ceil(F.col("_n") / piece_rows).alias("_rows"), F.ceil(F.col("_m") / piece_rows).alias("_cols")), "cell-sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_n").cast("double") * F.col("_m")), F.lit(0.0))).first()[0]
    tasks = int(min(MAX_TASKS, max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // pairs_per_task + 1)))
    shape = sizes.select("_cell", "_rows", "_cols")
    def dealt(df, columns, mine, others):
        own = F.pmod(F.xxhash64(*columns), F.col(mine))
        met = df.join(shape, "_cell").withColumn(mine, own).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        return met.repartition(tasks, "_cell", "_rows", "_cols")
    km = geo.haversine_km(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp"))
    met = dealt(left, [a_id, "_la", "_lo"], "_rows", "_cols").join(dealt(right, [b_id, "_lb", "_lp"], "_cols", "_rows").hint("merge"), ["_cell", "_rows", "_cols"])
    return met.filter(_within(radius_km)).withColumn("distance_km", km).filter(F.col("distance_km") <= radius_km).select(a_id, b_id, "distance_km")


def _within(radius_km: float) -> Column:
    """Latitudes no farther apart than the radius, with room for rounding: spares most other pairs the distance."""
    return F.abs(F.col("_la") - F.col("_lb")) <= math.degrees(radius_km / K.EARTH_RADIUS_KM) * (1 + 1e-9) + 1e-9


def temporal_window_match(sat: DataFrame, ground: DataFrame, values: list[str], window_minutes: float = 60.0,
                          key="station_id", sat_ts="timestamp_utc", ground_ts="timestamp_utc",
                          record_id: str | None = "record_id", ground_tie=("pm25",),
                          sat_tie=("distance_to_station_km", "latitude", "longitude")) -> DataFrame:
    """Closest ground reading of the same station within the time window, per satellite record.

    The nearest reading is either the last one before or the first one after, so
    the sides are stacked and two readings are carried to each record instead of
    pairing everything with everything.  Equally close: the earlier reading.
    Without a record id, one record per station and time is kept.
    """
    if record_id is None or record_id not in sat.columns:
        others = [c for c in sat.columns if c not in (key, sat_ts)]
        order = present(sat, sat_tie) or others
        sat = (sat.groupBy(key, sat_ts).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
               .select(key, sat_ts, "_r.*"))
        record_id = None
    located = sat.filter(F.col(key).isNotNull())
    readings = ground.groupBy(key, F.col(ground_ts).alias("_t")).agg(
        F.min_by(F.struct(F.col(ground_ts).alias("t"), *values), F.struct(*ground_tie)).alias("_g"))
    stacked = located.withColumns({"_t": F.col(sat_ts), "_kind": F.lit(1)}).unionByName(
        readings.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    tie = ["_kind"] + ([record_id] if record_id else [])
    near = series.carry(stacked, [key], "_t", tie, {"_prev": ("_g", "last"), "_next": ("_g", "next")}
                        ).filter(F.col("_kind") == 1)
    def gap(side):
        return F.abs(clock.micros(F.col("_t")) - clock.micros(F.col(f"{side}.t"))) / 60e6
    before, after = gap("_prev"), gap("_next")
    pick = F.when(after.isNull() | (before <= after), F.col("_prev")).otherwise(F.col("_next"))
    return (near.withColumn("_pick", pick).withColumn("temporal_offset_minutes", F.least(before, after))
            .filter(F.col("temporal_offset_minutes") <= window_minutes)
            .withColumns({v: F.col("_pick")[v] for v in values} | {"ground_timestamp": F.col("_pick")["t"]})
            .drop("_t", "_kind", "_g", "_prev", "_next", "_pick"))


def collocate(pixels: DataFrame, ground: DataFrame, values: list[str], radius_km: float = 25.0,
              window_minutes: float = 60.0, record_id: str | None = "record_id", ground_tie=("pm25",)) -> DataFrame:
    """Pixels paired with the nearest station's closest reading in time."""
    placed = nearest_station_within(pixels, distinct_stations(ground), radius_km)
    return temporal_window_match(placed.filter(F.col("station_id").isNotNull()), ground, values, window_minutes,
                                 record_id=record_id, ground_tie=ground_tie)


SWEEP = (("A", 10.0, 30.0), ("B", 25.0, 60.0), ("C", 50.0, 90.0))


def matching_sweep(pixels: DataFrame, ground: DataFrame, configs=SWEEP, record_id="record_id",
                   ground_tie=("pm25",)) -> DataFrame:
    """Matched pixels and collocated pairs per configuration, matched once at the widest setting."""
    radius, window = max(c[1] for c in configs), max(c[2] for c in configs)
    placed = nearest_station_within(pixels, distinct_stations(ground), radius)
    pairs = temporal_window_match(placed.filter(F.col("station_id").isNotNull()), ground, [ground_tie[0]],
                                  window, record_id=record_id, ground_tie=ground_tie)
    km, minutes = F.col("distance_to_station_km"), F.col("temporal_offset_minutes")
    matched = placed.agg(*[count_if(km <= r).alias(f"m_{n}") for n, r, _ in configs])
    paired = pairs.agg(*[count_if((km <= r) & (minutes <= w)).alias(f"p_{n}") for n, r, w in configs])
    table = F.array(*[F.struct(
        F.lit(n).alias("config"), F.lit(r).alias("spatial_radius_km"), F.lit(w).alias("time_window_min"),
        F.col(f"m_{n}").alias("spatial_matched"), F.col(f"_p.p_{n}").alias("collocated_pairs"))
        for n, r, w in configs])
    return with_row_of(matched, paired, "_p").select(F.inline(table))


def cell_hour_keys(df: DataFrame, ts="timestamp_utc", lat="latitude", lon="longitude") -> DataFrame:
    return df.withColumns({"_hour": clock.round_to_hour(F.col(ts)), "_lat": geo.cell(F.col(lat)),
                           "_lon": geo.cell(F.col(lon))})


def weather_cell_join(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join of the weather averaged per (nearest hour, 0.01 degree cell)."""
    names = [c for c in present(weather, K.WEATHER_COLUMNS) if c not in df.columns]
    keys = ["_hour", "_lat", "_lon"]
    mean = cell_hour_keys(weather).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])
    return cell_hour_keys(df).join(mean, keys, "left").drop(*keys)


def static_cell_join(df: DataFrame, static: DataFrame, order: list[str]) -> DataFrame:
    """Left join of the first static row (by ``order``) of each 0.01 degree cell."""
    names = [c for c in present(static, K.STATIC_COLUMNS) if c not in df.columns]
    keys = ["_lat", "_lon"]
    def keyed(t):
        return t.withColumns({"_lat": geo.cell(F.col("latitude")), "_lon": geo.cell(F.col("longitude"))})
    first = keyed(static).groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_s"))
    return (keyed(df).join(first, keys, "left").withColumns({c: F.col("_s")[c] for c in names})
            .drop("_s", *keys))


def species_outer_join(tables: list[DataFrame], keys=("latitude", "longitude", "timestamp_utc")) -> DataFrame:
    """Full outer join of per-species tables on their common key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys), "full_outer")
    return out


def daily_weather_join(daily: DataFrame, weather: DataFrame, key="date") -> DataFrame:
    return daily.join(weather, key, "inner")


def station_metadata_fill(df: DataFrame, stations: DataFrame, key="station_id",
                          columns=("station_name", "latitude", "longitude")) -> DataFrame:
    """Fill missing names and coordinates from the station table."""
    names = present(df, columns)
    meta = stations.select(key, *[F.col(c).alias(f"_m_{c}") for c in names])
    return (df.join(meta, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in names})
            .drop(*[f"_m_{c}" for c in names]))


def all_locations(districts: DataFrame, towns: DataFrame) -> DataFrame:
    """District seats and towns in one table; towns get tier 3 and come after districts."""
    head = districts.withColumns({"is_district_hq": F.lit(True), "_list": F.lit(0)})
    tail = towns.withColumns({"is_district_hq": F.lit(False), "has_monitor": F.lit(False), "tier": F.lit(3),
                              "_list": F.lit(1)})
    return head.unionByName(tail, allowMissingColumns=True)


def nearest_reference_point(points: DataFrame, refs: DataFrame, payload: list[str], order: list[str],
                            lat="latitude", lon="longitude", ref_lat="lat", ref_lon="lon") -> DataFrame:
    """Nearest reference (station, district, town) by flat-earth distance, rounded to 2 decimals."""
    found = nearest.nearest_any(points, refs, payload, order, lat, lon, ref_lat, ref_lon, distance=geo.flat_km)
    return found.withColumn("distance_km", F.bround("distance_km", 2))


def proximity_aggregate(grid: DataFrame, features: DataFrame, grid_id: str, radius_km: float = 0.5) -> DataFrame:
    """Per grid point: total length and covered share of features within the radius, and the
    distance of the nearest one.  Features carry a centre point, ``length_km`` and ``area_km2``.
    """
    cells = ProximityCells(radius_km)
    home = grid.select(grid_id, F.col("latitude").alias("_la"), F.col("longitude").alias("_lo")).withColumn(
        "_cell", cells.home(F.col("_la"), F.col("_lo")))
    # features at one spot are summed before they meet the grid
    spots = features.groupBy(F.col("latitude").alias("_fa"), F.col("longitude").alias("_fo")).agg(
        F.sum("length_km").alias("length_km"), F.sum("area_km2").alias("area_km2"),
        F.count(F.lit(1)).alias("features"))
    around = cells.spread(spots, "_fa", "_fo")
    km = geo.haversine_km(F.col("_la"), F.col("_lo"), F.col("_fa"), F.col("_fo"))
    near = home.join(around, "_cell").withColumn("_km", km).filter(F.col("_km") <= radius_km)
    disc = 3.141592653589793 * radius_km * radius_km
    sums = near.groupBy(grid_id).agg(F.sum("features").alias("features"), F.sum("length_km").alias("length_km"),
                                     (F.sum("area_km2") / disc * 100.0).alias("covered_pct"),
                                     F.min("_km").alias("nearest_km"))
    return (grid.join(sums, grid_id, "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("features", "length_km", "covered_pct")}))


def location_search(locations: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search over the name columns; blank text returns all."""
    needle = text.strip().lower()
    if not needle:
        return locations
    hit = F.lit(False)
    for c in present(locations, columns):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle)), F.lit(False))
    return locations.filter(hit)


def dedupe_closest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order`` (reduced map-side, so a hot key stays small)."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*keys, "_r.*"))


def satellite_carry_forward(times: DataFrame, composites: DataFrame, keys: list[str], values: list[str],
                            times_ts="timestamp_utc", composite_ts="timestamp_utc",
                            composite_tie=("record_id",), times_id=()) -> DataFrame:
    """Latest composite at or before each time, with its age in hours."""
    joined = series.asof_join(times, composites, keys, times_ts, composite_ts, values, list(composite_tie),
                              list(times_id))
    age = (clock.micros(F.col(times_ts)) - clock.micros(F.col("matched_ts"))) / 3600e6
    return joined.withColumn("satellite_age_hours", age).drop("matched_ts")


def station_latest(readings: DataFrame, stations: DataFrame, value: str, tie: list[str], ts="timestamp_utc",
                   key="station_id") -> DataFrame:
    """Every station with its newest reading, index, color and status."""
    newest = readings.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("pm25"), F.col(ts).alias("last_updated")),
                                                F.struct(ts, *tie)).alias("_l"))
    index = F.col("aqi")
    return (stations.join(newest, key, "left").select(*stations.columns, "_l.pm25", "_l.last_updated")
            .withColumn("aqi", aqi.pm25_index(F.col("pm25")))
            .withColumns({"category": aqi.category(index), "color": aqi.color_of_index(index),
                          "status": F.when(F.col("last_updated").isNull(), "NO DATA").otherwise("ACTIVE")}))


def recent_history(readings: DataFrame, value: str, hours: int = 24, ts="timestamp_utc", key="station_id") -> DataFrame:
    """Readings of each station's last hours (6 to 168) with index and category."""
    if not 6 <= hours <= 168:
        raise ValueError("hours must lie between 6 and 168")
    last = readings.groupBy(key).agg(F.max(ts).alias("_last"))
    recent = readings.join(last, key).filter(F.col(ts) > F.col("_last") - F.expr(f"INTERVAL {hours} HOURS")).drop("_last")
    return recent.withColumns({"aqi": aqi.pm25_index(F.col(value)), "category": aqi.pm25_category(F.col(value))})

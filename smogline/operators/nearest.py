"""Nearest-neighbour joins on latitude / longitude."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from smogline.functions.geo import BOX_DISTANCES, ProximityCells, flat_km, haversine_km
from smogline.operators.common import null_safe_join
from smogline.session import materialise

Distance = Callable[[Column, Column, Column, Column], Column]


def _positions(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct positions: repeated pixels of one place are matched once."""
    return (points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).distinct())


def _best(candidates: DataFrame, distance: Distance, order: list[str], payload: list[str]) -> DataFrame:
    """Closest candidate per position; equal to the millimetre, the lowest ``order`` values win."""
    scored = candidates.withColumn("_km", distance(F.col("_lat"), F.col("_lon"), F.col("r_lat"), F.col("r_lon")))
    return scored.groupBy("_lat", "_lon").agg(
        F.min_by(F.struct(F.col("_km").alias("km"), *[F.col(f"r_{p}").alias(p) for p in payload]),
                 F.struct(F.round("_km", 6), *[F.col(f"r_{o}") for o in order])).alias("_near"))


def _references(refs: DataFrame, lat: str, lon: str, columns: list[str]) -> DataFrame:
    return (refs.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .select(F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"),
                    *[F.col(c).alias(f"r_{c}") for c in dict.fromkeys(columns)]))


def nearest_within(points: DataFrame, refs: DataFrame, radius_km: float, payload: list[str], order: list[str],
                   lat="latitude", lon="longitude", ref_lat="latitude", ref_lon="longitude",
                   distance_name: str = "distance_km", distance: Distance = haversine_km) -> DataFrame:
    """Nearest reference within ``radius_km`` of every point; points without one keep nulls.

    Both sides are keyed by proximity cell, so only points and references of
    neighbouring cells meet.
    """
    cells = ProximityCells(radius_km)
    homes = _positions(points, lat, lon).withColumn("_cell", cells.home(F.col("_lat"), F.col("_lon")))
    around = cells.spread(_references(refs, ref_lat, ref_lon, payload + order), "r_lat", "r_lon")
    found = _best(homes.join(around, "_cell"), distance, order, payload).filter(F.col("_near.km") <= radius_km)
    keyed = points.withColumns({"_lat": F.col(lat), "_lon": F.col(lon)})
    return (keyed.join(found, ["_lat", "_lon"], "left")
            .withColumns({p: F.col("_near")[p] for p in payload} | {distance_name: F.col("_near.km")})
            .drop("_lat", "_lon", "_near"))


# References of one leaf, nodes that a search starts from at most, and the levels of the hierarchy: cells of
# 180 degrees down to about 300 metres, each a sixteenth of the one above.
LEAF = 32
START_NODES = 32
LEVELS = tuple(range(0, 17, 2))
SLACK_KM = 2e-6         # distances are compared to the millimetre
MAX_TASKS = 20_000
POSITIONS_PER_TASK = 4_000      # a position is small, what it sees on its way is not


def _node_id(level: int, lat: Column, lon: Column) -> Column:
    size = 180.0 / 2**level
    row, col = F.floor((lat + 90.0) / size).cast("long"), F.floor((lon + 180.0) / size).cast("long")
    return F.lit(level) * F.lit(2**48).cast("long") + row * 2**24 + (col + 2**23)


def _hierarchy(places: DataFrame, leaf: int) -> DataFrame:
    """(level, id, parent, leaf, node): the occupied cells of all levels with the box around their references and one of them."""
    lat, lon = F.col("r_lat"), F.col("r_lon")
    chain = F.array(*[F.struct(F.lit(level).alias("level"), _node_id(level, lat, lon).alias("id"),
                               (_node_id(LEVELS[i - 1], lat, lon) if i else F.lit(None).cast("long")).alias("parent")) for i, level in enumerate(LEVELS)])
    spread = places.select("r_lat", "r_lon", F.inline(chain))
    sums = spread.groupBy("level", "id", "parent").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("r_lat", "r_lon")).alias("spot"), F.min("r_lat").alias("south"), F.max("r_lat").alias("north"),
        F.min("r_lon").alias("west"), F.max("r_lon").alias("east"))
    is_leaf = (F.col("n") <= leaf) | (F.col("level") == LEVELS[-1])
    return sums.select("level", "id", "parent", is_leaf.alias("leaf"),
                       F.struct("id", is_leaf.alias("leaf"), "south", "north", "west", "east", F.col("spot.r_lat").alias("r_lat"), F.col("spot.r_lon").alias("r_lon")).alias("node"))


def _seen(nodes: Column, distance: Distance, box: Callable) -> Column:
    """What a position sees of nodes: a distance that no reference of the node comes under, and the distance of one of them."""
    lat, lon = F.col("_lat"), F.col("_lon")
    return F.transform(nodes, lambda n: F.struct(n["id"].alias("id"), n["leaf"].alias("leaf"), box(lat, lon, n).alias("least"),
                                                 distance(lat, lon, n["r_lat"], n["r_lon"]).alias("sure")))


def _pruned(df: DataFrame, candidates: Column, seen_before: Column | None = None) -> DataFrame:
    """Positions with the candidates that may still hold the nearest reference.

    The aggregation, by the key that the rows are already dealt by, keeps candidates and bound as values: the optimizer would else write
    the distances out again inside the comparison, for every pair of candidates.
    """
    sure = F.array_min(F.transform(candidates, lambda c: c["sure"]))
    bound = sure if seen_before is None else F.least(seen_before, sure)
    fixed = df.groupBy("_lat", "_lon").agg(F.first(candidates).alias("_all"), F.min(bound).alias("_bound"))
    return fixed.select("_lat", "_lon", "_bound", F.filter("_all", lambda c: c["least"] <= F.col("_bound") + SLACK_KM).alias("_kept"))


def nearest_any(points: DataFrame, refs: DataFrame, payload: list[str], order: list[str],
                lat="latitude", lon="longitude", ref_lat="latitude", ref_lon="longitude",
                distance_name: str = "distance_km", distance: Distance = flat_km, box: Callable | None = None,
                leaf: int = LEAF, start_nodes: int = START_NODES, positions_per_task: int = POSITIONS_PER_TASK) -> DataFrame:
    """Nearest reference at any distance, by branch and bound over a hierarchy of cells.

    Every occupied cell knows the box around its references and one of them.  A search starts from the finest level
    with few enough cells.  It drops cells whose box lies farther away than a reference already seen, opens the
    others level by level until they hold ``leaf`` places at most, and compares distances in those.  ``box`` gives the least
    possible distance to a box in the measure of ``distance``, so the stop rule holds across the date line where the measure does,
    and for points far from every reference.  References of one place meet once; the lowest ``order`` values stand for them.
    """
    box = box or BOX_DISTANCES[distance]
    slim = _references(refs, ref_lat, ref_lon, list(dict.fromkeys(payload + order)))
    rest = [c for c in slim.columns if c not in ("r_lat", "r_lon")]
    places = slim.groupBy("r_lat", "r_lon").agg(F.min_by(F.struct(*rest), F.struct(*[f"r_{o}" for o in order])).alias("_o")).select("r_lat", "r_lon", "_o.*")
    tree = materialise(_hierarchy(places, leaf), "cells")
    # one row a level
    sizes = {r["level"]: r for r in tree.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("leaf")).alias("inner")).collect()}
    start = max((level for level, r in sizes.items() if r["n"] <= start_nodes), default=LEVELS[0])
    inner = [level for level in LEVELS if level >= start and level in sizes and sizes[level]["inner"]]
    first = tree.filter(F.col("level") == start).agg(F.collect_list("node").alias("nodes"))
    # as many tasks as the positions need, on every level; by their bytes they would share a few
    spots = materialise(_positions(points, lat, lon), "positions")
    tasks = min(MAX_TASKS, spots.count() // positions_per_task + 1)
    search = spots.repartition(tasks, "_lat", "_lon").withColumn("_nodes", first.scalar())
    search = _pruned(search, _seen(F.col("_nodes"), distance, box))
    for level in inner:
        opened = tree.filter(F.col("level") == LEVELS[LEVELS.index(level) + 1]).groupBy("parent").agg(F.collect_list("node").alias("_nodes"))
        inside = search.select("_lat", "_lon", "_bound", F.filter("_kept", lambda c: c["leaf"]).alias("_done"), F.explode_outer(F.filter("_kept", lambda c: ~c["leaf"])).alias("_c"))
        seen = inside.join(opened, F.col("_c.id") == F.col("parent"), "left").select("_lat", "_lon", "_bound", "_done", "_nodes")
        met = seen.repartition(tasks, "_lat", "_lon").groupBy("_lat", "_lon").agg(
            F.min("_bound").alias("_old"), F.first("_done").alias("_done"), F.flatten(F.collect_list("_nodes")).alias("_nodes"))
        search = _pruned(met, F.concat("_done", _seen(F.col("_nodes"), distance, box)), F.col("_old"))
    # every place lies in one of the leaves below the start
    above = tree.filter(~F.col("leaf") & (F.col("level") >= start)).select(F.col("id").alias("parent"))
    ends = tree.filter(F.col("leaf") & (F.col("level") > start)).join(above, "parent", "left_semi").select("id").unionByName(
        tree.filter(F.col("leaf") & (F.col("level") == start)).select("id"))
    ids = F.array(*[_node_id(level, F.col("r_lat"), F.col("r_lon")) for level in LEVELS if level >= start])
    members = places.withColumn("id", F.explode(ids)).join(ends, "id")
    found = _best(search.select("_lat", "_lon", F.explode("_kept.id").alias("id")).join(members, "id"), distance, order, payload)
    keyed = points.withColumns({"_lat": F.col(lat), "_lon": F.col(lon)})
    return (null_safe_join(keyed, found, ["_lat", "_lon"], "left")
            .withColumns({p: F.col("_near")[p] for p in payload} | {distance_name: F.round("_near.km", 6)})
            .drop("_lat", "_lon", "_near"))

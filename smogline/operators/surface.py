"""Regular grids and interpolated surfaces."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, cos, radians

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from smogline import constants as K
from smogline.functions import aqi, geo, risk
from smogline.operators import nearest
from smogline.operators.common import null_safe_join


@dataclass(frozen=True)
class Grid:
    """A regular lattice; cells are numbered row by row from the south-west corner."""

    lat_min: float = K.REGION["lat_min"]
    lat_max: float = K.REGION["lat_max"]
    lon_min: float = K.REGION["lon_min"]
    lon_max: float = K.REGION["lon_max"]
    step: float = 0.05
    closed: bool = True             # does the lattice include its upper edge

    def _count(self, low: float, high: float) -> int:
        end = high + self.step / 2 if self.closed else high
        return max(ceil((end - low) / self.step - 1e-9), 0)

    @property
    def rows(self) -> int:
        return self._count(self.lat_min, self.lat_max)

    @property
    def cols(self) -> int:
        return self._count(self.lon_min, self.lon_max)

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def mean_lat(self) -> float:
        return self.lat_min + self.step * (self.rows - 1) / 2

    def row(self, cell: Column) -> Column:
        return F.floor(cell / self.cols).cast("int")

    def col(self, cell: Column) -> Column:
        return F.pmod(cell, F.lit(self.cols)).cast("int")

    def lat(self, cell: Column) -> Column:
        return F.round(self.lat_min + self.row(cell) * self.step, 4)

    def lon(self, cell: Column) -> Column:
        return F.round(self.lon_min + self.col(cell) * self.step, 4)

    def columns(self, cell: Column) -> dict[str, Column]:
        return {"latitude": self.lat(cell), "longitude": self.lon(cell)}

    def nearest_row(self, lat: Column) -> Column:
        return F.floor((lat - self.lat_min) / self.step + 0.5).cast("int")

    def nearest_col(self, lon: Column) -> Column:
        return F.floor((lon - self.lon_min) / self.step + 0.5).cast("int")


def region_grid(spark: SparkSession, grid: Grid = Grid(), id_format: str = "mh_grid_%06d") -> DataFrame:
    """The lattice as rows (grid_id, latitude, longitude)."""
    cell = F.col("id")
    return (spark.range(grid.size).withColumns(
        {"grid_id": F.format_string(id_format, cell)} | grid.columns(cell)).drop("id"))


# ---- inverse distance weighting -------------------------------------------

def _weight(lat1, lon1, lat2, lon2, mean_lat, power, min_km) -> Column:
    shrink = K.KM_PER_DEGREE * (cos(radians(mean_lat)) if isinstance(mean_lat, float) else F.cos(F.radians(mean_lat)))
    dy, dx = (lat1 - lat2) * K.KM_PER_DEGREE, (lon1 - lon2) * shrink
    km = F.greatest(F.sqrt(dy * dy + dx * dx), F.lit(min_km))
    return 1.0 / F.pow(km, F.lit(power))


def idw(known: DataFrame, value: str, grid: Grid, by: list[str] = (), power: float = 2.0, min_km: float = 0.05,
        default: float = 65.0) -> DataFrame:
    """Inverse-distance surface of a grid per ``by`` group (a time, say).

    Readings of one place are merged into their sum and number first.  Every place then adds its
    weight to every cell, which the map side already sums, so no group has to meet in one task.  Groups without any
    known value do not appear; an empty input with no ``by`` gives the default.
    """
    points = known.filter(F.col(value).isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    places = points.groupBy(*by, F.col("latitude").alias("_la"), F.col("longitude").alias("_lo")).agg(F.sum(value).alias("_v"), F.count(value).alias("_n"))
    cells = places.select(*by, "_v", "_n", "_la", "_lo", F.explode(F.sequence(F.lit(0), F.lit(grid.size - 1))).alias("cell"))
    w = _weight(grid.lat(F.col("cell")), grid.lon(F.col("cell")), F.col("_la"), F.col("_lo"), float(grid.mean_lat), power, min_km)
    sums = cells.withColumn("_w", w).groupBy(*by, "cell").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_wv"), F.sum(F.col("_w") * F.col("_n")).alias("_ws"))
    filled = sums.withColumn("value", F.col("_wv") / F.col("_ws"))
    if not by:
        every = known.sparkSession.range(grid.size).select(F.col("id").cast("int").alias("cell"))
        filled = every.join(filled, "cell", "left").withColumn("value", F.coalesce("value", F.lit(default)))
    return filled.withColumns(grid.columns(F.col("cell"))).select(*by, "cell", "latitude", "longitude", "value")


PLACES_PER_BLOCK = 1_024


def idw_leave_one_out(known: DataFrame, value: str, by: list[str], station="station_id", power: float = 2.0, min_km: float = 0.05,
                      block: int = PLACES_PER_BLOCK) -> DataFrame:
    """Each station's value estimated from the other stations of its group.

    One row per (group, station) is expected; rows without a value or place, and stations alone in their group, give no estimate.
    Distances are scaled at the estimated station's latitude.  Readings of one place are merged first.  The places of a group
    are dealt to blocks, and every pair of blocks is a task of its own whose partial sums are added, so a group of any
    size spreads over all tasks.  Null group values are a group.
    """
    group = F.struct(*[F.col(b) for b in by], F.lit(0).alias("one"))
    rows = known.filter(F.col(value).isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = rows.select(F.struct("*").alias("_row"), group.alias("_g"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), F.col(value).alias("_y"))
    places = rows.groupBy("_g", "_la", "_lo").agg(F.sum("_y").alias("_v"), F.count(F.lit(1)).alias("_n"))
    sizes = places.groupBy(F.col("_g").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    sized = places.join(sizes, F.col("_g") == F.col("_h")).withColumn("_own", F.pmod(F.xxhash64("_la", "_lo"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    target = sized.select("_g", F.col("_own").alias("_i"), every.alias("_j"), "_la", "_lo")
    source = sized.select(F.col("_g").alias("_h"), every.alias("_k"), F.col("_own").alias("_l"), F.col("_la").alias("_qa"), F.col("_lo").alias("_qo"), "_v", "_n")
    met = target.join(source, (F.col("_g") == F.col("_h")) & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l")) & ((F.col("_la") != F.col("_qa")) | (F.col("_lo") != F.col("_qo"))))
    w = _weight(F.col("_la"), F.col("_lo"), F.col("_qa"), F.col("_qo"), F.col("_la"), power, min_km)
    others = met.withColumn("_w", w).groupBy("_g", "_la", "_lo").agg(F.sum(F.col("_w") * F.col("_v")).alias("_wv"), F.sum(F.col("_w") * F.col("_n")).alias("_ws"))
    at = ["_g", "_la", "_lo"]
    joined = rows.join(places, at).join(others, at, "left")
    near = 1.0 / min_km**power      # the weight of other stations at the same place
    over = F.coalesce("_ws", F.lit(0.0)) + near * (F.col("_n") - 1)
    estimate = (F.coalesce("_wv", F.lit(0.0)) + F.when(F.col("_n") > 1, near * (F.col("_v") - F.col("_y"))).otherwise(0.0)) / over
    return joined.filter(over > 0).select("_row.*", estimate.alias("estimate"))


# ---- regression kriging ---------------------------------------------------

#: Stations farther than this from a tile are left out of its system; ten correlation lengths leave a covariance under 0.0001.
NEIGHBOURHOOD_KM = 400.0
TILE_CELLS = 64         # longest side of a tile, in cells


def _covariance(km: np.ndarray, length_km: float, nugget: float) -> np.ndarray:
    return (1.0 - nugget) * np.exp(-km / length_km)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _krige_tiles(grid: Grid, side: int, length_km: float, nugget: float, power: float, min_km: float):
    """Evaluate rows of one tile each, whose last columns are tile, spread, n and the known places around it."""
    scale = np.array([K.KM_PER_DEGREE, K.KM_PER_DEGREE * np.cos(np.radians(grid.mean_lat))])
    across = -(-grid.cols // side)

    def solve(tile, spread, n, known):
        rows = np.arange(tile // across * side, min((tile // across + 1) * side, grid.rows))
        cols = np.arange(tile % across * side, min((tile % across + 1) * side, grid.cols))
        cells = (rows[:, None] * grid.cols + cols[None, :]).ravel()
        if not n:
            return cells, np.zeros(len(cells)), np.full(len(cells), 15.0)
        if not known:
            return cells, np.zeros(len(cells)), np.full(len(cells), spread or 10.0)
        xy = np.column_stack((np.round(grid.lat_min + (cells // grid.cols) * grid.step, 4), np.round(grid.lon_min + (cells % grid.cols) * grid.step, 4))) * scale
        at, residual, count = np.array([(k["la"], k["lo"]) for k in known]) * scale, np.array([k["r"] for k in known]), np.array([k["n"] for k in known])
        km = _apart(xy, at)
        try:
            # readings of one place share its signal: their mean carries the nugget divided by their number
            half = np.linalg.cholesky(_covariance(_apart(at, at), length_km, nugget) + np.diag(nugget / count))
            seen = np.linalg.solve(half, _covariance(km, length_km, nugget).T)
            left = np.sqrt(np.maximum(0.0, 1.0 - (seen * seen).sum(axis=0)))
            return cells, seen.T @ np.linalg.solve(half, residual), left * spread if spread else np.full(len(cells), 10.0)
        except np.linalg.LinAlgError:
            w = count / np.maximum(km, min_km) ** power
            return cells, (w @ residual) / w.sum(axis=1), 8.0 + 0.15 * np.minimum(km.min(axis=1), 100.0)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                cells, add, se = solve(*(c.to_pylist()[0] for c in row.columns[-4:]))
                repeated = [c.take(pa.array(np.zeros(len(cells), dtype=np.int64))) for c in row.columns[:-4]]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(cells, pa.int32()), pa.array(add), pa.array(se)], names=[*row.schema.names[:-4], "cell", "correction", "kriging_se"])
    return run


def _reach(at: Column, low: float, tile: float, reach: float, count: int) -> tuple[Column, Column]:
    """First and last of ``count`` tiles of width ``tile`` that come within ``reach`` of a coordinate."""
    return F.greatest(F.floor((at - reach - low) / tile), F.lit(0)), F.least(F.floor((at + reach - low) / tile + 1e-9), F.lit(count - 1))


def regression_kriging(stations: DataFrame, grid: Grid, by: list[str] = (), grid_trend: Column | None = None,
                       length_km: float = 40.0, nugget: float = 0.1, radius_km: float = NEIGHBOURHOOD_KM, tile_cells: int | None = None) -> DataFrame:
    """Trend plus kriged station residuals on a grid, with the estimation error, per group.

    ``stations`` holds one row per (group, station): latitude, longitude, observed, trend.
    ``grid_trend`` is an expression over the group's columns, cell, latitude and longitude.

    Moving neighbourhood: the grid is cut into square tiles, every tile gets the stations within ``radius_km`` of it and solves one small system
    by Cholesky for its own cells, so neither a group nor the grid stands in one task; a task holds the covariances of one neighbourhood.
    Where the radius covers all stations the surface equals the global solve.  A tile without stations around it has no
    correction and the group's whole spread as error.  Without ``by`` and without any station the surface is the trend with an error of 15;
    with ``by``, groups without stations do not appear.
    """
    by = list(by)
    side = tile_cells or max(1, min(TILE_CELLS, round(radius_km / (2 * grid.step * K.KM_PER_DEGREE))))
    down, across = -(-grid.rows // side), -(-grid.cols // side)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    used = stations.filter(located & F.col("observed").isNotNull() & F.col("trend").isNotNull()).select(
        *by, F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), (F.col("observed") - F.col("trend")).cast("double").alias("_r"))
    groups = used.groupBy(*by).agg(F.stddev_pop("_r").alias("_spread"), F.count(F.lit(1)).alias("_n"))
    places = used.groupBy(*by, "_la", "_lo").agg(F.avg("_r").alias("r"), F.count(F.lit(1)).alias("n"))
    lat_km, lon_km = K.KM_PER_DEGREE, K.KM_PER_DEGREE * cos(radians(grid.mean_lat))
    span = side * grid.step
    rows, cols = _reach(F.col("_la"), grid.lat_min, span, radius_km / lat_km, down), _reach(F.col("_lo"), grid.lon_min, span, radius_km / lon_km, across)
    met = places.filter((rows[0] <= rows[1]) & (cols[0] <= cols[1])).withColumn("_tr", F.explode(F.sequence(*rows))).withColumn("_tc", F.explode(F.sequence(*cols)))

    def gap(at: str, tile: str, low: float, cells: int) -> Column:
        first = low + F.col(tile) * span
        last = low + (F.least((F.col(tile) + 1) * side, F.lit(cells)) - 1) * grid.step
        return F.greatest(F.lit(0.0), first - F.col(at), F.col(at) - last)

    dy, dx = gap("_la", "_tr", grid.lat_min, grid.rows) * lat_km, gap("_lo", "_tc", grid.lon_min, grid.cols) * lon_km
    met = met.filter(dy * dy + dx * dx <= radius_km * radius_km)
    around = met.groupBy(*by, (F.col("_tr") * across + F.col("_tc")).alias("_tile")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_la").alias("la"), F.col("_lo").alias("lo"), "r", "n"))).alias("_known"))
    tiles = groups.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down * across - 1).cast("long"))))
    work = null_safe_join(tiles, around, [*by, "_tile"], "left").select(*by, F.col("_n").alias("_stations"), "_tile", "_spread", "_n", "_known")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema.fields[:len(by) + 1])
    placed = work.mapInArrow(_krige_tiles(grid, side, length_km, nugget, 2.0, 0.05), f"{kinds}cell int, correction double, kriging_se double")
    placed = placed.withColumns(grid.columns(F.col("cell")))
    trend = grid_trend if grid_trend is not None else F.lit(0.0)
    value = F.when(F.col("_stations") == 0, trend).otherwise(F.greatest(F.lit(0.0), trend + F.col("correction")))
    return placed.select(*by, "cell", "kriging_se", "latitude", "longitude", value.alias("value"))


def _loo_tiles(length_km: float, nugget: float):
    """Kriged value of a tile's own stations from the others around it, from one inverse; rows end with the group's mean latitude, sum and number, and the known stations."""
    def solve(mean_lat, total, n, known):
        scale = np.array([K.KM_PER_DEGREE, K.KM_PER_DEGREE * np.cos(np.radians(mean_lat))])
        at, y = np.array([(k["la"], k["lo"]) for k in known]) * scale, np.array([k["y"] for k in known])
        own = np.array([k["own"] for k in known])
        inverse = np.linalg.pinv(_covariance(_apart(at, at), length_km, nugget) + np.eye(len(y)) * nugget)
        # leaving row i out: its weights on the others are -inverse[i, j] / inverse[i, i]
        weights = -inverse / np.diag(inverse)[:, None]
        np.fill_diagonal(weights, 0.0)
        trend = (total - y) / max(n - 1, 1)          # mean of the others
        estimate = weights @ y + (1.0 - weights.sum(axis=1)) * trend
        return [k["row"] for k, o in zip(known, own) if o], y[own], estimate[own]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                rows, y, estimate = solve(*(c.to_pylist()[0] for c in row.columns))
                kind = row.schema.field(3).type.value_type.field("row").type
                yield pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(y), pa.array(estimate)], names=["row", "observed", "estimate"])
    return run


def kriging_leave_one_out(known: DataFrame, value: str, by: list[str], station="station_id", length_km: float = 40.0,
                          nugget: float = 0.1, radius_km: float = NEIGHBOURHOOD_KM) -> DataFrame:
    """Each station's value kriged from the other stations of its group around their mean.

    Stations are tiled with a halo of ``radius_km``: a tile solves one system for its own stations, so no group stands in one task.  Stations
    alone in their group, and rows without value or place, give no estimate.
    """
    rows = known.filter(F.col(value).isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.struct(*by, F.lit(0).alias("_one")).alias("_g"), F.struct(*by, station).alias("row"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"), F.col(value).cast("double").alias("y"))
    groups = rows.groupBy(F.col("_g").alias("_h")).agg(F.avg("la").alias("_mean"), F.sum("y").alias("_total"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sized = rows.join(groups, F.col("_g") == F.col("_h"))
    y, x = F.col("la") * K.KM_PER_DEGREE / radius_km, F.col("lo") * K.KM_PER_DEGREE * F.cos(F.radians("_mean")) / radius_km
    around = [F.explode(F.sequence(F.floor(at - 1), F.floor(at + 1))) for at in (y, x)]
    spread = sized.withColumn("_tr", around[0]).withColumn("_tc", around[1]).withColumn("own", (F.col("_tr") == F.floor(y)) & (F.col("_tc") == F.floor(x)))
    tiles = spread.groupBy("_g", "_tr", "_tc").agg(F.first("_mean").alias("_mean"), F.first("_total").alias("_total"), F.first("_n").alias("_n"),
                                                   F.array_sort(F.collect_list(F.struct("la", "lo", "y", "own", "row"))).alias("_known"), F.max("own").alias("_any")).filter("_any")
    kind = rows.schema["row"].dataType.simpleString()
    return tiles.select("_mean", "_total", "_n", "_known").mapInArrow(_loo_tiles(length_km, nugget), f"row {kind}, observed double, estimate double").select("row.*", "observed", "estimate")


# ---- surface columns ------------------------------------------------------

def surface_classify(df: DataFrame, value: str, grid: Grid) -> DataFrame:
    """Category, RGBA and image indices (row 0 at the top) of grid values."""
    rgba = aqi.overlay_rgba(F.col(value))
    return df.withColumns({
        "category": aqi.category(F.col(value), rounding=False), "image_row": (grid.rows - 1 - grid.row(F.col("cell"))),
        "image_col": grid.col(F.col("cell")), "red": rgba["r"], "green": rgba["g"], "blue": rgba["b"], "alpha": rgba["a"]})


def surface_uncertainty(df: DataFrame, stations: DataFrame, value: str, metric: str = "pm25", pblh: float = 700.0,
                        station_id="station_id") -> DataFrame:
    """Margin and reliability of grid estimates from the distance to the nearest station;
    ``layer`` holds the selected metric."""
    near = nearest.nearest_any(df, stations, [station_id], [station_id], distance_name="distance_km",
                               distance=geo.flat_km)
    km = F.bround("distance_km", 2)
    interval = risk.prediction_interval(F.bround(F.col(value), 1), km, F.lit(False), F.lit(pblh))
    score = risk.reliability(km, F.lit(False), F.lit(False), F.lit(0.15))
    out = near.withColumns({"distance_km": km, "_i": interval, "_r": score})
    out = out.withColumns({"pm25_pred": F.bround(F.col(value), 1), "uncertainty": F.col("_i.margin_of_error"),
                           "reliability": F.col("_r.reliability_score")})
    layer = {"uncertainty": "uncertainty", "reliability": "reliability"}.get(metric, "pm25_pred")
    return out.withColumn("layer", F.col(layer).cast("double")).drop("_i", "_r")


# ---- resampling -----------------------------------------------------------

def to_lattice(df: DataFrame, value: str, grid: Grid, by: list[str] = ()) -> DataFrame:
    """Mean of a pixel table per lattice node (nearest node)."""
    r, c = grid.nearest_row(F.col("latitude")), grid.nearest_col(F.col("longitude"))
    inside = r.between(0, grid.rows - 1) & c.between(0, grid.cols - 1)
    return (df.filter(inside).groupBy(*by, r.alias("row"), c.alias("col")).agg(F.avg(value).alias("value")))


def regrid_bilinear(nodes: DataFrame, source: Grid, target: Grid, by: list[str] = ()) -> DataFrame:
    """Bilinear resampling of lattice nodes (row, col, value) to another lattice.

    Each source node adds its share to the target nodes around it; a target node
    whose four surrounding source nodes are not all known stays null.
    """
    ratio = source.step / target.step
    reach = ceil(ratio)
    at_row = (source.lat_min + F.col("row") * source.step - target.lat_min) / target.step
    at_col = (source.lon_min + F.col("col") * source.step - target.lon_min) / target.step
    def around(at):
        return F.sequence(F.ceil(at - reach - 1e-9).cast("int"), F.floor(at + reach + 1e-9).cast("int"))
    spread = (nodes.withColumns({"_r": at_row, "_c": at_col})
              .withColumn("t_row", F.explode(around(F.col("_r")))).withColumn("t_col", F.explode(around(F.col("_c")))))
    share = (F.greatest(1.0 - F.abs(F.col("t_row") - F.col("_r")) / ratio, F.lit(0.0))
             * F.greatest(1.0 - F.abs(F.col("t_col") - F.col("_c")) / ratio, F.lit(0.0)))
    inside = F.col("t_row").between(0, target.rows - 1) & F.col("t_col").between(0, target.cols - 1)
    parts = spread.withColumn("_w", share).filter(inside & (F.col("_w") > 1e-9))
    sums = parts.groupBy(*by, F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg(
        F.sum(F.col("_w") * F.col("value")).alias("_wv"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("_w"))).alias("_ws"))
    cell = F.col("row") * target.cols + F.col("col")
    return (sums.withColumn("value", F.when(F.col("_ws") > 1.0 - 1e-6, F.col("_wv")))
            .withColumns(target.columns(cell)).select(*by, "row", "col", "latitude", "longitude", "value"))

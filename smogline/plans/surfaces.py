"""Queries of grids and interpolated surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline.operators import surface
from smogline.operators.surface import Grid
from smogline.plans import sqltext as S
from smogline.plans.registry import query

COARSE = Grid(step=0.5)


def _grid_sql(step: float, rows: int, cols: int) -> str:
    return (f"SELECT CAST(i AS INT) AS cell, CAST(i // {cols} AS INT) AS r, CAST(i % {cols} AS INT) AS c, round(15.6::DOUBLE + (i // {cols}) * {step}::DOUBLE, 4) AS latitude, "
            f"round(72.6::DOUBLE + (i % {cols}) * {step}::DOUBLE, 4) AS longitude FROM range({rows * cols}) AS g(i)")


@query("region_grid", "latitude longitude", f"""
    SELECT 'mh_grid_' || lpad(CAST(cell AS VARCHAR), 6, '0') AS grid_id, latitude, longitude, coalesce(n, 0) AS pixels
    FROM ({_grid_sql(0.05, 131, 167)}) g LEFT JOIN (
      SELECT CAST(floor((latitude - 15.6::DOUBLE) / 0.05::DOUBLE + 0.5::DOUBLE) AS INT) AS r, CAST(floor((longitude - 72.6::DOUBLE) / 0.05::DOUBLE + 0.5::DOUBLE) AS INT) AS c,
             count(*) AS n FROM v_pixels GROUP BY ALL) p ON g.r = p.r AND g.c = p.c""")
def _grid(t):
    grid = Grid()
    cells = surface.region_grid(t.spark, grid)
    row, col = grid.nearest_row(F.col("latitude")), grid.nearest_col(F.col("longitude"))
    counts = t.v_pixels.groupBy(row.alias("_r"), col.alias("_c")).agg(F.count(F.lit(1)).alias("pixels"))
    keyed = cells.withColumns({"_r": grid.nearest_row(F.col("latitude")), "_c": grid.nearest_col(F.col("longitude"))})
    return keyed.join(counts, ["_r", "_c"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0))).drop("_r", "_c")


_DAILY = """SELECT strftime(timestamp_utc, '%Y-%m-%d') AS date, station_id, latitude, longitude, avg(pm25) AS observed
            FROM v_ground_located GROUP BY ALL"""


def _daily(t):
    date = F.to_date("timestamp_utc").cast("string").alias("date")
    return t.v_ground_located.groupBy(date, "station_id", "latitude", "longitude").agg(F.avg("pm25").alias("observed"))


def _weight(mean_lat: str, a: str, b: str) -> str:
    return (f"1.0 / pow(greatest(sqrt(pow(({a}.latitude - {b}.latitude) * 111.0, 2) + pow(({a}.longitude - {b}.longitude) * 111.0 "
            f"* cos(radians({mean_lat})), 2)), 0.05), 2)")


_MEAN_LAT = f"{COARSE.mean_lat!r}::DOUBLE"
_IDW_SQL = f"""SELECT d.date, g.cell, g.r, g.c, g.latitude, g.longitude, sum({_weight(_MEAN_LAT, 'g', 'd')} * d.observed) / sum({_weight(_MEAN_LAT, 'g', 'd')}) AS value
    FROM ({_grid_sql(0.5, COARSE.rows, COARSE.cols)}) g, ({_DAILY}) d GROUP BY ALL"""


@query("idw", "latitude longitude value", f"SELECT date, cell, latitude, longitude, value FROM ({_IDW_SQL})")
def _idw(t):
    return surface.idw(_daily(t), "observed", COARSE, ["date"])


@query("regression_kriging", "latitude longitude kriging_se value")
def _kriging(t):
    daily = _daily(t)
    mean = daily.groupBy("date").agg(F.avg("observed").alias("level"))
    stations = daily.join(mean, "date").withColumn("trend", F.col("level"))
    return surface.regression_kriging(stations, COARSE, ["date", "level"], F.col("level")).drop("level")


# one reading a day for the northern and the southern half: systems of one or two stations, which SQL can solve
_ZONES = f"""SELECT date, latitude >= 18.85::DOUBLE AS north, avg(latitude) AS latitude, avg(longitude) AS longitude, avg(observed) AS observed FROM ({_DAILY}) GROUP BY ALL"""


def _zones(t):
    return _daily(t).groupBy("date", (F.col("latitude") >= 18.85).alias("north")).agg(*[F.avg(c).alias(c) for c in ("latitude", "longitude", "observed")])


def _km(a: str, b: str) -> str:
    return f"sqrt(pow(({a}.latitude - {b}.latitude) * 111.0, 2) + pow(({a}.longitude - {b}.longitude) * 111.0 * cos(radians({_MEAN_LAT})), 2))"


def _zone_sql() -> str:
    seen = lambda km: f"0.9::DOUBLE * exp(-{km} / 40.0::DOUBLE)"
    return f"""
    WITH z AS ({_ZONES}), l AS (SELECT date, avg(observed) AS level FROM z GROUP BY date), r AS (SELECT z.*, level, observed - level AS e FROM z JOIN l USING (date)),
         p AS (SELECT a.date, a.level, a.latitude AS ya, a.longitude AS xa, a.e AS ea, b.latitude AS yb, b.longitude AS xb, b.e AS eb,
                      CASE WHEN b.date IS NULL THEN 0 ELSE {seen(_km('a', 'b'))} END AS k, CASE WHEN b.date IS NULL THEN 0 ELSE abs(a.e - b.e) / 2 END AS spread
               FROM r a LEFT JOIN r b ON a.date = b.date AND a.north <> b.north WHERE b.date IS NULL OR a.north),
         c AS (SELECT p.*, g.cell, g.latitude, g.longitude, {seen(_km('g', 'q').replace('q.latitude', 'p.ya').replace('q.longitude', 'p.xa'))} AS ca,
                      CASE WHEN yb IS NULL THEN 0 ELSE {seen(_km('g', 'q').replace('q.latitude', 'p.yb').replace('q.longitude', 'p.xb'))} END AS cb
               FROM p, ({_grid_sql(0.5, COARSE.rows, COARSE.cols)}) g)
    SELECT date, cell, latitude, longitude, greatest(0, level + ((ca - k * cb) * ea + (cb - k * ca) * coalesce(eb, 0)) / (1 - k * k)) AS value,
           CASE WHEN spread > 0 THEN sqrt(greatest(0, 1 - (ca * ca - 2 * k * ca * cb + cb * cb) / (1 - k * k))) * spread ELSE 10 END AS kriging_se FROM c"""


@query("regression_kriging_zones", "latitude longitude kriging_se value", _zone_sql())
def _kriging_zones(t):
    zones = _zones(t)
    stations = zones.join(zones.groupBy("date").agg(F.avg("observed").alias("level")), "date").withColumn("trend", F.col("level"))
    return surface.regression_kriging(stations, COARSE, ["date", "level"], F.col("level"), radius_km=2_000.0, tile_cells=4).drop("level")


@query("surface_compare_loo", "mae rmse r2", f"""
    WITH d AS ({_DAILY}), e AS (SELECT a.date, a.station_id, any_value(a.observed) AS y, sum({_weight('a.latitude', 'a', 'b')} * b.observed) / sum({_weight('a.latitude', 'a', 'b')}) AS p
               FROM d a JOIN d b ON a.date = b.date AND a.station_id <> b.station_id GROUP BY ALL)
    SELECT count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e""")
def _loo(t):
    from smogline.operators.profile import regression_metrics
    return regression_metrics(surface.idw_leave_one_out(_daily(t), "observed", ["date"]), "observed", "estimate")


@query("surface_compare_kriging", "mae rmse r2")
def _loo_kriging(t):
    from smogline.operators.profile import regression_metrics
    return regression_metrics(surface.kriging_leave_one_out(_daily(t), "observed", ["date"]), "observed", "estimate")


@query("surface_compare_kriging_zones", "mae rmse r2", f"""
    WITH z AS ({_ZONES}), e AS (SELECT a.observed AS y, b.observed AS p FROM z a JOIN z b ON a.date = b.date AND a.north <> b.north)
    SELECT count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e""")
def _loo_kriging_zones(t):
    # of two stations, each one's estimate is the other around itself
    from smogline.operators.profile import regression_metrics
    return regression_metrics(surface.kriging_leave_one_out(_zones(t), "observed", ["date"], station="north"), "observed", "estimate")


_RGBA = {n: i for i, n in enumerate(("red", "green", "blue", "alpha"))}


@query("surface_classify", "latitude longitude value", f"""
    SELECT date, cell, latitude, longitude, value, category, {COARSE.rows - 1} - r AS image_row, c AS image_col,
           {', '.join("CASE category " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in surface.K.OVERLAY_RGBA.items()) + f" END AS {n}" for n, i in _RGBA.items())}
    FROM (SELECT *, {S.category('value', False)} AS category FROM ({_IDW_SQL}))""")
def _classify(t):
    return surface.surface_classify(surface.idw(_daily(t), "observed", COARSE, ["date"]), "value", COARSE)


_UNC_KM = S.flat("g.latitude", "g.longitude", "s.latitude", "s.longitude")


@query("surface_uncertainty", "latitude longitude value distance_km pm25_pred uncertainty layer", f"""
    WITH n AS (SELECT date, cell, g.latitude, g.longitude, value, s.station_id, round({_UNC_KM}, 6) AS km FROM ({_IDW_SQL}) g, v_stations s
               QUALIFY row_number() OVER (PARTITION BY date, cell ORDER BY round({_UNC_KM}, 6), s.station_id) = 1),
         k AS (SELECT *, {S.bround('km', 2)} AS distance_km FROM n),
         m AS (SELECT *, 1.645::DOUBLE * (12.5::DOUBLE * (1.0 + 0.03::DOUBLE * least(distance_km, 30.0)) * 1.0 * 1.0) AS raw,
                      round_even(100.0::DOUBLE - least(distance_km * 1.5, 30.0) - 3.0, 0) AS score FROM k)
    SELECT date, cell, latitude, longitude, value, station_id, distance_km, {S.bround('value')} AS pm25_pred, {S.bround('raw')} AS uncertainty,
           CAST(least(greatest(score, 25), 99) AS INT) AS reliability, {S.bround('raw')} AS layer FROM m""")
def _uncertainty(t):
    values = surface.idw(_daily(t), "observed", COARSE, ["date"])
    return surface.surface_uncertainty(values, t.v_stations, "value", "uncertainty")


SOURCE = Grid(step=0.5)
TARGET = Grid(step=0.2)


def _bilinear_sql() -> str:
    s, d = SOURCE, TARGET
    return f"""
    WITH i AS (SELECT CAST(floor((latitude - 15.6::DOUBLE) / 0.5 + 0.5) AS INT) AS r, CAST(floor((longitude - 72.6::DOUBLE) / 0.5 + 0.5) AS INT) AS c,
                      aod_550nm FROM v_pixels),
         n AS (SELECT r, c, avg(aod_550nm) AS v FROM i WHERE r BETWEEN 0 AND {s.rows - 1} AND c BETWEEN 0 AND {s.cols - 1} GROUP BY r, c),
         k AS (SELECT r, c, CASE WHEN (r * 31 + c) % 29 = 0 THEN NULL ELSE v END AS v FROM n),
         g AS (SELECT cell, r AS row, c AS col, latitude, longitude, r * 0.4::DOUBLE AS y, c * 0.4::DOUBLE AS x FROM ({_grid_sql(0.2, d.rows, d.cols)})),
         p AS (SELECT g.row, g.col, latitude, longitude, v, (1 - abs(k.r - y)) * (1 - abs(k.c - x)) AS w FROM g JOIN k
               ON abs(k.r - y) < 1 - 1e-9 AND abs(k.c - x) < 1 - 1e-9)
    SELECT row, col, latitude, longitude, CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 1 - 1e-6 THEN sum(w * v) END AS value
    FROM p WHERE w > 1e-9 GROUP BY row, col, latitude, longitude"""


@query("regrid_bilinear", "latitude longitude value", _bilinear_sql())
def _regrid(t):
    nodes = surface.to_lattice(t.v_pixels, "aod_550nm", SOURCE)
    holes = nodes.withColumn("value", F.when((F.col("row") * 31 + F.col("col")) % 29 != 0, F.col("value")))
    return surface.regrid_bilinear(holes, SOURCE, TARGET)


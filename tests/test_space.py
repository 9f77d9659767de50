"""Nearest search, quantiles and surfaces against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from smogline.functions.geo import flat_km, haversine_km
from smogline.operators import matching, nearest, quantiles, surface
from smogline.operators.surface import Grid


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def scattered():
    rng = random.Random(3)
    points = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(150)]
    points += [(200 + i, rng.uniform(15, 22), rng.uniform(72, 81)) for i in range(100)] + [(999, 10.0, 179.95)]
    refs = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(120)]
    refs += [(500 + i, rng.uniform(15, 22), rng.uniform(72, 81)) for i in range(60)] + [(900, 10.0, -179.95)]
    return points, refs


def frames(spark, scattered):
    points, refs = scattered
    return (spark.createDataFrame(points, "id int, latitude double, longitude double"),
            spark.createDataFrame(refs, "station_id int, latitude double, longitude double"))


@pytest.mark.parametrize("radius", [25.0, 800.0])
def test_nearest_within(spark, scattered, radius):
    p, r = frames(spark, scattered)
    got = {x["id"]: x for x in nearest.nearest_within(p, r, radius, ["station_id"], ["station_id"]).collect()}
    assert len(got) == len(scattered[0])
    for i, la, lo in scattered[0]:
        d, s = min((km((la, lo), (b, c)), k) for k, b, c in scattered[1])
        if d <= radius:
            assert got[i]["station_id"] == s and got[i]["distance_km"] == pytest.approx(d)
        else:
            assert got[i]["station_id"] is None
    assert got[999]["station_id"] == 900        # across the date line


def flat(a, b):
    return 111.0 * math.hypot(a[0] - b[0], (a[1] - b[1]) * math.cos(math.radians(a[0])))


@pytest.mark.parametrize("count", [0, 1, 5, 64, 65, 500])
@pytest.mark.parametrize("measure, brute", [(haversine_km, km), (flat_km, flat)])
def test_nearest_any(spark, count, measure, brute):
    """Few and many references, the date line, the poles, far points, repeated places, missing coordinates."""
    rng = random.Random(count)
    refs = [(i, rng.uniform(15, 22), rng.uniform(72, 81)) if i % 3 else (i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(count)]
    refs += [(1000 + i, b, c) for i, b, c in refs[:40]] + [(2000, 10.0, -179.95)] * (count > 1) + [(3000, None, 5.0), (3001, 5.0, None)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [(200 + i, rng.uniform(15, 22), rng.uniform(72, 81)) for i in range(80)]
    points += [(900, 10.0, 179.95), (901, 90.0, 0.0), (902, -90.0, 100.0), (903, 18.0, 76.0), (903, 18.0, 76.0)]
    located = [r for r in refs if None not in r]
    p = spark.createDataFrame([*points, (999, None, 3.0), (998, 3.0, None)], "id int, latitude double, longitude double")
    r = spark.createDataFrame(refs, "station_id int, latitude double, longitude double")
    got = nearest.nearest_any(p, r, ["station_id"], ["station_id"], distance=measure, leaf=4, start_nodes=9).collect()
    assert len(got) == len(points) + 2
    where = {i: (a, b) for i, a, b in points}
    for x in got:
        if x["id"] in (998, 999) or not located:
            assert x["station_id"] is None and x["distance_km"] is None
        else:
            d, s = min((round(brute(where[x["id"]], (b, c)), 6), k) for k, b, c in located)
            assert x["station_id"] == s and x["distance_km"] == pytest.approx(d, abs=2e-6)


@pytest.mark.parametrize("shares, accuracy", [(None, 1000), ((0.0, 0.5, 1.0), 50), (quantiles.SHARES, 1000), (None, 20)])
def test_quantiles(spark, shares, accuracy):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, float("nan"), -3.0, 0.0, -0.0] + [rng.gauss(0, 100) for _ in range(9)]),
             1013 + rng.uniform(-0.05, 0.05)) for _ in range(700)]
    rows += [("void", None, None), ("void", float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["g"], ["x", "y"], probs, accuracy, shares).collect()
    assert sorted(str(r["g"]) for r in got) == ["None", "a", "b", "hot", "void"]
    for r in got:
        for c, k in (("x", 1), ("y", 2)):
            known = [row[k] for row in rows if row[0] == r["g"] and row[k] is not None and row[k] == row[k]]
            want = list(np.quantile(known, probs)) if known else [None] * len(probs)
            assert [r[quantiles.column_name(c, p)] for p in probs] == pytest.approx(want)
    every = quantiles.exact_quantiles(df, [], ["y"], [0.5], accuracy, shares).first()
    assert every["y_p50"] == pytest.approx(np.median([r[2] for r in rows if r[2] is not None]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantiles(df, [], ["x"], [0.5]).first()["x_p50"] is None


def test_grid_sizes():
    assert (Grid().rows, Grid().cols, Grid().size) == (131, 167, 21877)
    assert Grid(step=0.08).size == 8610
    assert Grid(18.4, 18.65, 73.7, 74.0, 0.01, closed=False).size == 25 * 30


def test_idw_returns_the_station_value(spark):
    grid = Grid(18.0, 18.2, 73.0, 73.2, 0.1)
    known = spark.createDataFrame([(18.0, 73.0, 50.0), (18.2, 73.2, 100.0)], "latitude double, longitude double, v double")
    got = {r["cell"]: r["value"] for r in surface.idw(known, "v", grid).collect()}
    assert len(got) == 9 and got[0] == pytest.approx(50.0, abs=1) and 50 < got[4] < 100
    empty = surface.idw(known.limit(0), "v", grid).collect()
    assert {r["value"] for r in empty} == {65.0}


def test_leave_one_out_uses_the_other_stations_of_the_group(spark):
    rows = [(d, s, 18.0 + s * 0.1, 73.0 + (s * 7 % 5) * 0.1, float(s * 3 + (d or 9))) for d in (0, 1, None) for s in range(6)]
    known = spark.createDataFrame(rows, "d int, station_id int, latitude double, longitude double, v double")
    got = {(r["d"], r["station_id"]): r["estimate"] for r in surface.idw_leave_one_out(known, "v", ["d"]).collect()}
    assert len(got) == 18
    for d, s, la, lo, _ in rows:
        k = [(max(0.05, np.hypot((la - b) * 111.0, (lo - c) * 111.0 * np.cos(np.radians(la)))) ** -2, v) for e, o, b, c, v in rows if e == d and o != s]
        assert got[d, s] == pytest.approx(sum(w * v for w, v in k) / sum(w for w, _ in k))
    assert surface.idw_leave_one_out(known.filter("d = 0"), "v", []).count() == 6


def test_kriging_equals_direct_solve(spark):
    grid = Grid(18.0, 18.4, 73.0, 73.4, 0.1)
    stations = [(0, 18.05, 73.05, 60.0, 50.0), (0, 18.3, 73.2, 40.0, 50.0), (0, 18.2, 73.35, 55.0, 50.0)]
    df = spark.createDataFrame(stations, "h int, latitude double, longitude double, observed double, trend double")
    got = {r["cell"]: r for r in surface.regression_kriging(df, grid, ["h"], F.lit(50.0)).collect()}
    scale = np.array([111.0, 111.0 * np.cos(np.radians(18.2))])
    s = np.array([[a, b] for _, a, b, _, _ in stations]) * scale
    g = np.array([[18.0 + i // 5 * 0.1, 73.0 + i % 5 * 0.1] for i in range(25)]) * scale
    res = np.array([o - t for *_, o, t in stations])
    cs = 0.9 * np.exp(-np.linalg.norm(s[:, None] - s[None], axis=2) / 40.0) + np.eye(3) * 0.1
    cg = 0.9 * np.exp(-np.linalg.norm(g[:, None] - s[None], axis=2) / 40.0)
    w = np.linalg.solve(cs, cg.T).T
    assert [got[i]["value"] for i in range(25)] == pytest.approx(list(np.maximum(0, 50 + w @ res)))
    assert [got[i]["kriging_se"] for i in range(25)] == pytest.approx(list(np.sqrt(np.maximum(0, 1 - (w * cg).sum(1))) * res.std()))


def _direct(grid, stations, radius, tile):
    """Every cell from a solve of the stations within the radius of its tile."""
    scale = np.array([111.0, 111.0 * np.cos(np.radians(grid.mean_lat))])
    xy, res = np.array([(a, b) for a, b, _ in stations]), np.array([r for *_, r in stations])
    out = []
    for i in range(grid.size):
        r, c = divmod(i, grid.cols)
        low = np.array([grid.lat_min + r // tile * tile * grid.step, grid.lon_min + c // tile * tile * grid.step])
        high = np.array([grid.lat_min + (min((r // tile + 1) * tile, grid.rows) - 1) * grid.step, grid.lon_min + (min((c // tile + 1) * tile, grid.cols) - 1) * grid.step])
        used = np.hypot(*(np.maximum(0, np.maximum(low - xy, xy - high)) * scale).T) <= radius
        if not used.any():
            out.append((50.0, res.std()))
            continue
        s, g = xy[used] * scale, np.array([grid.lat_min + r * grid.step, grid.lon_min + c * grid.step]) * scale
        k = 0.9 * np.exp(-np.linalg.norm(s[:, None] - s[None], axis=2) / 40.0) + np.eye(len(s)) * 0.1
        cg = 0.9 * np.exp(-np.linalg.norm(s - g, axis=1) / 40.0)
        w = np.linalg.solve(k, cg)
        out.append((max(0, 50 + w @ res[used]), np.sqrt(max(0, 1 - w @ cg)) * res.std()))
    return out


@pytest.mark.parametrize("radius, tile", [(5_000.0, 2), (60.0, 2), (25.0, 3), (5_000.0, None)])
def test_kriging_by_tiles(spark, radius, tile):
    """Moving neighbourhoods equal a direct solve of what they reach, and the global one where they reach all; without ``by`` too."""
    rng, grid = random.Random(2), Grid(18.0, 18.9, 73.0, 73.7, 0.1)
    stations = [(rng.uniform(17.9, 18.4), rng.uniform(72.9, 73.9), rng.uniform(-20, 20)) for _ in range(25)]
    stations += [(18.05, 73.05, 4.0), (18.05, 73.05, -3.0)]      # two readings of one place
    df = spark.createDataFrame([(a, b, 50.0 + r, 50.0) for a, b, r in stations] + [(None, 73.0, 1.0, 1.0), (18.0, 73.0, None, 1.0)], "latitude double, longitude double, observed double, trend double")
    got = {r["cell"]: r for r in surface.regression_kriging(df, grid, [], F.lit(50.0), radius_km=radius, tile_cells=tile).collect()}
    assert len(got) == grid.size
    for i, (value, se) in enumerate(_direct(grid, stations, radius, tile or 99)):
        assert got[i]["value"] == pytest.approx(value) and got[i]["kriging_se"] == pytest.approx(se)


def test_kriging_without_stations(spark):
    grid, none = Grid(18.0, 18.2, 73.0, 73.2, 0.1), spark.createDataFrame([], "latitude double, longitude double, observed double, trend double")
    got = surface.regression_kriging(none, grid, [], F.lit(-5.0)).collect()
    assert len(got) == 9 and {(r["value"], r["kriging_se"]) for r in got} == {(-5.0, 15.0)}
    lone = surface.regression_kriging(spark.createDataFrame([(18.1, 73.1, 60.0, 50.0)], none.schema), grid, (), F.lit(50.0)).collect()
    assert {r["kriging_se"] for r in lone} == {10.0} and max(r["value"] for r in lone) == pytest.approx(59.0)


@pytest.mark.parametrize("block", [2, 1024])
def test_leave_one_out_by_blocks(spark, block):
    rng = random.Random(6)
    rows = [("a", i, 18.0 + (i % 9) * 0.1, 73.0 + (i % 4) * 0.1, rng.uniform(0, 90)) for i in range(40)] + [("b", 1, 18.0, 73.0, 5.0), ("c", 1, 18.0, 73.0, 5.0), ("c", 2, 18.0, 73.0, 7.0), ("a", 99, None, 73.0, 1.0)]
    known = spark.createDataFrame(rows, "d string, station_id int, latitude double, longitude double, v double")
    got = {(r["d"], r["station_id"]): r["estimate"] for r in surface.idw_leave_one_out(known, "v", ["d"], block=block).collect()}
    assert len(got) == 42 and got["c", 1] == pytest.approx(7.0) and got["c", 2] == pytest.approx(5.0)
    located = [r for r in rows if r[2]]
    for d, s, la, lo, _ in located:
        k = [(max(0.05, np.hypot((la - b) * 111.0, (lo - c) * 111.0 * np.cos(np.radians(la)))) ** -2, v) for e, o, b, c, v in located if e == d and o != s]
        if k:
            assert got[d, s] == pytest.approx(sum(w * v for w, v in k) / sum(w for w, _ in k))


def test_kriging_leave_one_out_by_tiles(spark):
    """With a short halo every station is estimated from the stations of the tiles around its own."""
    rng = random.Random(9)
    rows = [(0, i, 18.0 + rng.uniform(0, 3), 73.0 + rng.uniform(0, 3), rng.uniform(20, 90)) for i in range(40)]
    df = spark.createDataFrame(rows, "h int, station_id int, latitude double, longitude double, v double")
    got = {r["station_id"]: r["estimate"] for r in surface.kriging_leave_one_out(df, "v", ["h"], radius_km=120.0).collect()}
    mean = np.mean([r[2] for r in rows])
    xy = np.array([(r[2] * 111.0, r[3] * 111.0 * np.cos(np.radians(mean))) for r in rows])
    tile, y = np.floor(xy / 120.0), np.array([r[4] for r in rows])
    for i in range(40):
        near = [j for j in range(40) if j != i and (np.abs(tile[j] - tile[i]) <= 1).all()]
        k = 0.9 * np.exp(-np.linalg.norm(xy[near][:, None] - xy[near][None], axis=2) / 40.0) + np.eye(len(near)) * 0.1
        w = np.linalg.solve(k, 0.9 * np.exp(-np.linalg.norm(xy[near] - xy[i], axis=1) / 40.0))
        trend = (y.sum() - y[i]) / 39
        assert got[i] == pytest.approx(w @ y[near] + (1 - w.sum()) * trend)


def test_kriging_leave_one_out_equals_direct_solve(spark):
    rows = [(0, i, 18.0 + 0.1 * i, 73.0 + 0.07 * (i * i % 5), 40.0 + 5 * (i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "h int, station_id int, latitude double, longitude double, v double")
    got = {r["station_id"]: r["estimate"] for r in surface.kriging_leave_one_out(df, "v", ["h"]).collect()}
    mean_lat = np.mean([r[2] for r in rows])
    xy = np.array([[r[2] * 111.0, r[3] * 111.0 * np.cos(np.radians(mean_lat))] for r in rows])
    y = np.array([r[4] for r in rows])
    for i in range(6):
        keep = [j for j in range(6) if j != i]
        c = 0.9 * np.exp(-np.linalg.norm(xy[keep][:, None] - xy[keep][None], axis=2) / 40.0) + np.eye(5) * 0.1
        c0 = 0.9 * np.exp(-np.linalg.norm(xy[keep] - xy[i], axis=1) / 40.0)
        m = y[keep].mean()
        assert got[i] == pytest.approx(m + np.linalg.solve(c, c0) @ (y[keep] - m))


def test_regrid_reproduces_a_plane(spark):
    source, target = Grid(0, 2, 0, 2, 0.5), Grid(0, 2, 0, 2, 0.2)
    nodes = spark.createDataFrame([(r, c, 2.0 * r * 0.5 + 3.0 * c * 0.5) for r in range(5) for c in range(5)], "row int, col int, value double")
    out = surface.regrid_bilinear(nodes, source, target).collect()
    assert len(out) == 121
    assert all(x["value"] == pytest.approx(2 * x["latitude"] + 3 * x["longitude"]) for x in out)


def test_distance_matrix_of_a_dense_cell_by_pieces(spark):
    rng = np.random.default_rng(8)
    a = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(rng.uniform((18.5, 73.8), (18.56, 73.86), (120, 2)))] + [(None, 18.5, 73.8), (200, None, 73.8), (201, 18.5, 73.8), (201, 18.5, 73.8)]
    b = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(rng.uniform((18.5, 73.8), (18.56, 73.86), (90, 2)))] + [(91, 18.5, None), (92, -40.0, 10.0)]
    left, right = spark.createDataFrame(a, "p long, latitude double, longitude double"), spark.createDataFrame(b, "s long, latitude double, longitude double")
    got = matching.haversine_matrix(left, right, 3.0, "p", "s", piece_rows=16, pairs_per_task=500)
    tasks = got.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 4
    brute = left.dropna(subset=["latitude"]).alias("l").crossJoin(right.dropna().alias("r")).select("p", "s", haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude")).alias("distance_km")).filter("distance_km <= 3")
    norm = lambda df: sorted((str(r["p"]), r["s"], r["distance_km"]) for r in df.collect())
    assert norm(got) == norm(brute) and brute.count() > 1000


def test_nearest_any_positions_are_dealt_to_tasks(spark):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform((15, 72), (22, 81), (60, 2)))], "p long, latitude double, longitude double")
    refs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform((15, 72), (22, 81), (400, 2)))], "id long, latitude double, longitude double")
    want, got = (sorted(tuple(r) for r in nearest.nearest_any(points, refs, ["id"], ["id"], positions_per_task=n).collect()) for n in (1_000, 7))
    assert got == want and len(got) == 60


def test_quantiles_of_whole_columns_side_by_side(spark):
    rng = np.random.default_rng(10)
    rows = [(float(x), None if i % 3 == 0 else int(y), float("nan") if i % 5 == 0 else float(z), None) for i, (x, y, z) in enumerate(rng.normal(0, 50, (5000, 3)))]
    df = spark.createDataFrame(rows, "x double, y long, z double, none double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    table = quantiles.exact_quantiles(df, [], ["x", "y", "z", "none"], probs)
    assert "Join" not in table._jdf.queryExecution().toString()     # rows are counted where they stand
    row = table.first()
    known = {"x": [r[0] for r in rows], "y": [r[1] for r in rows if r[1] is not None], "z": [r[2] for r in rows if r[2] == r[2]]}
    for c, values in known.items():
        assert [row[quantiles.column_name(c, p)] for p in probs] == pytest.approx(list(np.quantile(values, probs)))
    assert [row[quantiles.column_name("none", p)] for p in probs] == [None] * 5

"""Series operators equal plain windows however small the blocks and slices are."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from smogline.operators import matching, series, splits


@pytest.fixture(scope="module")
def readings(spark):
    """One station holds most rows; times repeat; values repeat and go missing."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        station = "hot" if rng.random() < 0.8 else rng.choice("abc")
        when = datetime(2024, 1, 1) + timedelta(minutes=5 * rng.randrange(2000))
        rows.append((i, station, when, None if rng.random() < 0.2 else float(rng.randrange(3))))
    return spark.createDataFrame(rows, "id int, station_id string, timestamp_utc timestamp_ntz, v double")


def plain():
    return Window.partitionBy("station_id").orderBy("timestamp_utc", "id")


def same(a, b):
    order = sorted(a.columns)
    assert sorted(map(str, a.select(order).collect())) == sorted(map(str, b.select(order).collect()))


def test_rank(readings):
    got = series.rank(readings, ["station_id"], "timestamp_utc", ["id"], name="rn")
    same(got, readings.withColumn("rn", F.row_number().over(plain()).cast("long")))


@pytest.mark.parametrize("block", [24, 31, 100_000])
def test_lags_and_rolling(readings, block):
    got = series.lag_lead_features(readings, "v", tie=["id"], lags=[1, 24], horizons=[1, 24], rolling=True, rows_per_block=block)
    want = readings.withColumns({
        "v_lag_1h": F.lag("v", 1).over(plain()), "v_lag_24h": F.lag("v", 24).over(plain()),
        "v_rolling_mean_6h": F.avg("v").over(plain().rowsBetween(-5, 0)), "v_rolling_mean_24h": F.avg("v").over(plain().rowsBetween(-23, 0)),
        "v_rolling_std_24h": F.coalesce(F.stddev_samp("v").over(plain().rowsBetween(-23, 0)), F.lit(0.0)),
        "target_lead_1h": F.lead("v", 1).over(plain()), "target_lead_24h": F.lead("v", 24).over(plain())})
    rounded = {c: F.round(c, 9) for c in want.columns if "rolling" in c}
    same(got.withColumns(rounded), want.withColumns(rounded))


def test_carry_both_ways(readings):
    got = series.carry(readings, ["station_id"], "timestamp_utc", ["id"], {"p": ("v", "last"), "n": ("v", "next")}, slice_seconds=1800)
    want = readings.withColumns({
        "p": F.last("v", ignorenulls=True).over(plain().rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.first("v", ignorenulls=True).over(plain().rowsBetween(0, Window.unboundedFollowing))})
    same(got, want)


@pytest.fixture(scope="module")
def one_moment(spark):
    """A station whose rows share one time stamp, one whose rows have none, and a usual one."""
    rng = random.Random(12)
    rows = [(i, "moment", datetime(2024, 1, 1), rng.choice([None, 1.0, 2.0])) for i in range(3000)] + [(5000 + i, "timeless", None, rng.choice([None, 3.0])) for i in range(2000)]
    rows += [(9000 + i, None if i % 2 else "x", datetime(2024, 1, 1, i % 24), float(i)) for i in range(50)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, station_id string, timestamp_utc timestamp_ntz, v double").repartition(5)


def test_large_slices_are_cut(one_moment):
    parts = series._sliced(one_moment, ["station_id"], "timestamp_utc", 3600, ["id"], 100)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert sum(sizes) == 5050 and max(sizes) < 600
    got = series.rank(one_moment, ["station_id"], "timestamp_utc", ["id"], name="rn", rows_per_slice=100)
    same(got, one_moment.withColumn("rn", F.row_number().over(plain()).cast("long")))
    got = series.carry(one_moment, ["station_id"], "timestamp_utc", ["id"], {"p": ("v", "last"), "n": ("v", "next")}, rows_per_slice=100)
    same(got, one_moment.withColumns({
        "p": F.last("v", ignorenulls=True).over(plain().rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.first("v", ignorenulls=True).over(plain().rowsBetween(0, Window.unboundedFollowing))}))
    got = series.windowed(one_moment, ["station_id"], "timestamp_utc", ["id"], 2, 1, lambda w: {"a": F.lag("v", 2).over(w), "b": F.lead("v").over(w)}, 64, rows_per_slice=100)
    same(got, one_moment.withColumns({"a": F.lag("v", 2).over(plain()), "b": F.lead("v").over(plain())}))


def test_flatline_keeps_three_and_a_gap_breaks_the_run(spark):
    data = [5.0, 5.0, 5.0, 5.0, 5.0, None, 5.0, 5.0, 5.0, 5.0, 6.0]
    df = spark.createDataFrame([(i, "s", datetime(2024, 1, 1) + timedelta(hours=i), v) for i, v in enumerate(data)],
                               "id int, station_id string, timestamp_utc timestamp_ntz, pm25 double")
    got = [r["pm25"] for r in series.flatline_mask(df, ["pm25"], tie=["id"], rows_per_block=3).orderBy("id").collect()]
    assert got == [5.0, 5.0, 5.0, None, None, None, 5.0, 5.0, 5.0, None, 6.0]


def test_stuck_drop_removes_the_sixth(spark):
    df = spark.createDataFrame([(i, "s", datetime(2024, 1, 1) + timedelta(hours=i), 7.0) for i in range(8)],
                               "id int, station_id string, timestamp_utc timestamp_ntz, pm25 double")
    assert [r["id"] for r in series.stuck_drop(df, "pm25", tie=["id"]).orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_gap_limit(spark):
    hours = [0, 1, 2, 3, 10]
    vals = [0.0, None, None, 3.0, None]
    df = spark.createDataFrame([(i, "s", datetime(2024, 1, 1) + timedelta(hours=h), v) for i, (h, v) in enumerate(zip(hours, vals))],
                               "id int, station_id string, timestamp_utc timestamp_ntz, pm25 double")
    got = [r["pm25"] for r in series.gap_interpolate(df, "pm25", tie=["id"]).orderBy("id").collect()]
    assert got == pytest.approx([0.0, 1.0, 2.0, 3.0]+[None])


def test_lag_impute_fills_per_station_then_with_the_median(spark):
    rows = [(i, s, datetime(2024, 1, 1) + timedelta(hours=i), float(v)) for s, base in (("a", 10), ("b", 100)) for i, v in enumerate(range(base, base + 5))]
    df = spark.createDataFrame(rows, "id int, station_id string, timestamp_utc timestamp_ntz, pm25_ground double")
    lagged = series.lag_lead_features(df, tie=["id"])
    out = {(r["station_id"], r["id"]): r for r in series.lag_impute(lagged, tie=["id"]).collect()}
    assert len(out) == 8                                   # the last row of each station has no lead
    assert out[("b", 0)]["pm25_ground_lag_1h"] == 100.0    # next known lag of the same station
    assert out[("a", 0)]["pm25_ground_lag_24h"] == 57.0    # nothing known: median of all targets


def test_temporal_match_equals_brute_force(spark, readings):
    sat = readings.filter("id % 3 = 0").select(F.col("id").alias("record_id"), "station_id", "timestamp_utc")
    ground = readings.filter("id % 3 = 1").select("id", "station_id", "timestamp_utc", F.col("id").cast("double").alias("pm25"))
    got = matching.temporal_window_match(sat, ground, ["pm25"], 45.0)
    pairs = sat.join(ground.withColumnRenamed("timestamp_utc", "g"), "station_id").withColumn(
        "off", F.abs(F.unix_micros(F.col("timestamp_utc").cast("timestamp")) - F.unix_micros(F.col("g").cast("timestamp"))) / 60e6).filter("off <= 45")
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("record_id").orderBy("off", "g", "pm25"))).filter("k = 1")
    same(got.select("record_id", "pm25", F.col("temporal_offset_minutes").alias("off")), best.select("record_id", "pm25", "off"))


def test_one_pair_of_two_pixels(spark):
    px = spark.createDataFrame([(18.53, 73.85, datetime(2024, 1, 1, 10, 30), 0.4), (18.50, 73.92, datetime(2024, 1, 1, 10, 30), 0.5)],
                               "latitude double, longitude double, timestamp_utc timestamp_ntz, aod_550nm double")
    gr = spark.createDataFrame([("A", 18.5314, 73.8446, datetime(2024, 1, 1, 10, 45), 60.0), ("B", 18.5089, 73.926, datetime(2024, 1, 1, 15, 0), 80.0)],
                               "station_id string, latitude double, longitude double, timestamp_utc timestamp_ntz, pm25 double")
    rows = matching.collocate(px, gr, ["pm25"], record_id=None).collect()
    assert [(r["station_id"], r["temporal_offset_minutes"]) for r in rows] == [("A", 15.0)]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.0, 1.0])
def test_row_fraction_split(readings, share):
    got = splits.temporal_split(readings, tie=["id"], test_share=share)
    n = readings.count()
    order = readings.withColumn("k", F.row_number().over(Window.orderBy("timestamp_utc", "id")))
    want = order.select("id", F.when(F.col("k") <= int(n * (1 - share)), "train").otherwise("test").alias("split"))
    same(got.select("id", "split"), want)


def test_rows_without_a_time_come_last(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else start + timedelta(hours=i)) for i in range(12)], "id int, timestamp_utc timestamp_ntz")
    timed = [1, 2, 4, 5, 7, 8, 10, 11]
    for share, train in ((0.5, timed[:6]), (0.2, [*timed, 0])):
        got = splits.temporal_split(df, tie=["id"], test_share=share).filter("split = 'train'")
        assert sorted(r["id"] for r in got.collect()) == sorted(train)


def test_no_more_folds_than_stations(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, station_id string")
    assert {r["fold"] for r in splits.group_kfold(df, folds=5).select("fold").collect()} == {0, 1}


def test_folds_do_not_share_stations(readings):
    dealt = splits.group_kfold(readings, folds=3)
    per = dealt.groupBy("station_id").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per) and dealt.count() == readings.count()


def test_fold_modes_fit_or_raise(spark):
    one = spark.createDataFrame([(i, "s", 15.0 + i * 0.1, 1.0 * i) for i in range(40)], "id int, station_id string, latitude double, x double")
    by_latitude = splits.spatial_kfold(one, "latitude", folds=4)
    assert [r["count"] for r in by_latitude.groupBy("fold").count().collect()] == [10, 10, 10, 10]
    by_row = splits.spatial_kfold(one.drop("latitude"), "row", folds=4)
    assert {r["fold"] for r in by_row.select("fold").collect()} <= {0, 1, 2, 3} and by_row.count() == 40
    for mode, df in (("station", one), ("latitude", one.filter("id < 3")), ("latitude", one.drop("latitude")), ("anything", one)):
        with pytest.raises(ValueError):
            splits.spatial_kfold(df, mode)


@pytest.mark.parametrize("share", [0.9, 0.45, 0.2, 0.0])
def test_cut_inside_one_time_stamp(spark, share, monkeypatch):
    """Daily stamps, half of the rows without a time, ties in the tie column, equal rows: counted, never ranked."""
    rng = random.Random(7)
    rows = [(rng.randint(0, 300) if i % 5 else None, None if i % 2 else datetime(2024, 1, 1 + (i % 20 == 0)), "same" if i % 3 else str(i)) for i in range(1200)]
    rows += [(7, datetime(2024, 1, 1), "same")] * 40
    df = spark.createDataFrame(rows, "id int, timestamp_utc timestamp_ntz, note string").repartition(6)
    monkeypatch.setattr(splits.selection.kth_key, "__defaults__", (20,))
    got = splits.temporal_split(df, tie=["id"], test_share=share).collect()
    key = lambda r: (r[1] is None, r[1] or datetime.min, r[0] is not None, r[0] or 0, r[2])
    want = sorted(rows, key=key)[:int(len(rows) * (1 - share))]
    assert len(got) == len(rows) and sorted(((r["id"], r["timestamp_utc"], r["note"]) for r in got if r["split"] == "train"), key=key) == want


def test_kth_number_over_all_longs(spark):
    values = [-2**63, -5, 0, 0, 3, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [splits.selection.kth_number(df, F.col("v"), k + 1)[0] for k in range(7)] == values

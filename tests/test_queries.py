"""Every registered query against its SQL on the smallest tables; jobs with state."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import _rows
from smogline.operators import features, models
from smogline.plans import all_queries
from smogline.plans.views import BASE_TABLES, Tables
from smogline.session import work_folder
from smogline.sources import readers, sinks
from smogline.streaming import hourly

FOLDER = entry.SMOKE_FOLDER
SLOW = {"train_baselines", "train_horizons", "ablation"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in SLOW])
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    text = entry.oracle_sql().get(name)
    if text is None:
        assert got[0]
        return
    want = sql.sql(text)
    assert got == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_models_train_and_score(spark):
    t = Tables(spark, FOLDER)
    frame = t.v_features.filter("pm25_ground IS NOT NULL")
    train, test = frame.filter("timestamp_utc < '2000-01-01'"), frame.filter("timestamp_utc >= '2000-01-01'")
    table = models.train_baselines(train, test, "weather_only", folds=2, rf_trees=2, rf_depth=2, gbt_rounds=1, gbt_depth=2).collect()
    assert sorted(r["model"] for r in table) == ["boosted_trees", "linear_regression", "random_forest"]
    assert sum(r["is_best"] for r in table) == 1 and all(r["cv_mae"] > 0 for r in table)


def test_feature_set_state_survives(spark):
    t = Tables(spark, FOLDER)
    fs = features.FeatureSet("weather_gis", scale=True, keep=["record_id"]).fit(t.v_features)
    path = work_folder(spark, "features")
    fs.save(path)
    again = features.FeatureSet.load(spark, path)
    a, b = (x.transform(t.v_features).orderBy("record_id").limit(20).collect() for x in (fs, again))
    assert a == b and again.names == fs.names
    # a table without some columns still gets the training columns
    assert again.transform(t.v_features.drop("road_density")).columns == ["record_id", *fs.names]


def test_daily_sink_replaces_only_its_days(spark):
    t = Tables(spark, FOLDER)
    path = work_folder(spark, "daily")
    sinks.daily_parquet(t.v_obs_long, path)
    before = spark.read.parquet(path).count()
    sinks.daily_parquet(t.v_obs_long.filter("timestamp_utc < '2024-01-02'"), path)
    assert spark.read.parquet(path).count() == before == readers.scan_parquet_union(spark, path).count()


def test_stream_drops_late_rows_and_repeats(spark):
    folder = work_folder(spark, "stream")
    start = datetime(2024, 1, 1)
    def row(i, minutes, value=50.0):
        return (i, 1, start + timedelta(minutes=minutes), "pm25", value)
    kind = "record_id int, station_id int, timestamp_utc timestamp_ntz, parameter string, value double"
    batches = [[row(1, 10), row(2, 20, 70.0)], [row(2, 20, 70.0), row(3, 400, 30.0)], [row(4, 15, 90.0), row(5, 800, 10.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = hourly.read_files(spark, f"{folder}/in", "*.parquet", spark.read.parquet(f"{folder}/in").schema)
        hourly.run_hourly(stream, f"{folder}/out", f"{folder}/state")
    out = {r["hour"]: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert out[start]["pm25"] == 60.0 and out[start]["readings"] == 2      # repeat ignored, late row dropped
    assert start + timedelta(hours=6) in out and start + timedelta(hours=13) not in out


def test_the_forecast_is_split_after_its_windows_are_stored(spark, monkeypatch):
    seen = []
    split = models.temporal_split
    monkeypatch.setattr(models, "temporal_split", lambda df, *args: seen.append(df) or split(df, *args))
    t = Tables(spark, FOLDER)
    train, test = models.forecast_rows(t.v_features.filter("pm25_ground IS NOT NULL"), tie=["record_id"])
    assert seen[0].inputFiles() and "Window" not in seen[0]._jdf.queryExecution().toString()
    assert train.count() == int((train.count() + test.count()) * 0.8) > 0


def test_ablation_builds_one_pair_of_matrices(spark, monkeypatch):
    made = []
    build = models.filled_matrices
    monkeypatch.setattr(models, "filled_matrices", lambda fs, *args: made.append(build(fs, *args)) or made[-1])
    frame = Tables(spark, FOLDER).v_features.filter("pm25_ground IS NOT NULL")
    train, test = frame.filter("timestamp_utc < '2000-01-01'"), frame.filter("timestamp_utc >= '2000-01-01'")
    table = models.ablation(train, test, rounds=1, depth=2).collect()
    assert len(made) == 1 and [r["feature_group"] for r in table] == ["weather_only", "weather_gis", "full"]
    # a group's columns hold what its own matrices would
    fs = features.FeatureSet("weather_gis", keep=["pm25_ground"]).fit(train)
    own = build(fs, train, test)
    for mine, wide in zip(own, made[0]):
        assert sorted(map(str, mine.select(*fs.names).collect())) == sorted(map(str, wide.select(*fs.names).collect()))


def test_training_rows_stand_in_even_parts_and_models_predict_once(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 100, raising=False)
    frame = Tables(spark, FOLDER).v_features.filter("pm25_ground IS NOT NULL").coalesce(1)
    train, test = frame.filter("timestamp_utc < '2000-01-01'"), frame.filter("timestamp_utc >= '2000-01-01'")
    written = {}
    keep = models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, label: written.setdefault(label, keep(df, label)))
    table = models.train_baselines(train, test, "weather_only", folds=2, rf_trees=2, rf_depth=2, gbt_rounds=1, gbt_depth=2)
    sizes = [r["count"] for r in written["train"].groupBy(F.input_file_name().alias("file")).count().collect()]
    assert sum(sizes) == train.count() > 300 and max(sizes) <= 150 and max(sizes) - min(sizes) <= 10
    assert set(table.inputFiles()) == set(written["scores"].inputFiles()) and table.count() == 3


@pytest.mark.parametrize("name, forests, boosted", [("train_baselines", 6, 6), ("train_horizons", 0, 4), ("ablation", 0, 3)])
def test_registered_models_are_fitted_in_their_full_sizes(spark, monkeypatch, name, forests, boosted):
    fit, asked = models.fit, []

    def quick(df, names, target, estimator, impute=True):
        asked.append(estimator)
        return fit(df, names[:3], target, models.estimators()["linear_regression"], impute)
    monkeypatch.setattr(models, "fit", quick)
    assert entry.queries()[name](spark, FOLDER).count() in (3, 4)
    sizes = [(e.getNumTrees(), e.getMaxDepth()) if hasattr(e, "getNumTrees") else (e.getMaxIter(), e.getMaxDepth()) for e in asked if hasattr(e, "getMaxDepth")]
    assert sorted(sizes) == [(100, 12)] * forests + [(300, 6)] * boosted
    # rounds of boosting need a folder, else their lineage only grows
    assert spark.sparkContext.getCheckpointDir()

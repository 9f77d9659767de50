"""Training, evaluation and batch scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline import constants as K
from smogline.operators import series
from smogline.operators.common import with_row_of
from smogline.operators.features import FeatureSet
from smogline.operators.imputing import fit_medians
from smogline.operators.profile import persistence_baseline, regression_metrics
from smogline.operators.splits import spatial_kfold, temporal_split
from smogline.session import materialise, work_folder


PART_ROWS = 50_000      # rows of a part of a table that models are fitted on
AT_ONCE = 4             # models fitted side by side: a boosted one is some two thousand small jobs, which leave most cores idle


def dealt_evenly(df: DataFrame) -> DataFrame:
    """The rows in even parts of about PART_ROWS; a table of one part stays as it is.

    A fit scans its table dozens of times, in as many tasks as the table has parts: one large file or row group at the source would leave all of it to one task.
    """
    parts = math.ceil(df.count() / PART_ROWS)
    return df.repartition(parts) if parts > 1 else df


def side_by_side(spark: SparkSession, jobs: list[Callable[[], DataFrame]], at_once: int = AT_ONCE) -> list[DataFrame]:
    """What the jobs return, in their order.  A job fits a model and stores its scores, so that no model outlives it."""
    if spark.sparkContext.getCheckpointDir() is None:
        # boosting cuts the lineage of its rounds only where there is a folder for it
        spark.sparkContext.setCheckpointDir(work_folder(spark, "models"))
    with ThreadPool(at_once) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def estimators(rf_trees: int = 100, rf_depth: int = 12, gbt_rounds: int = 300, gbt_step: float = 0.05,
               gbt_depth: int = 6, subsample: float = 0.8, seed: int = 42) -> dict[str, object]:
    """The three baseline regressors."""
    return {
        # the trace of ridge keeps the normal equations solvable when one input is a sum of others
        "linear_regression": LinearRegression(labelCol="label", solver="normal", regParam=1e-6),
        "random_forest": RandomForestRegressor(labelCol="label", numTrees=rf_trees, maxDepth=rf_depth, seed=seed),
        "boosted_trees": GBTRegressor(labelCol="label", maxIter=gbt_rounds, stepSize=gbt_step, maxDepth=gbt_depth,
                                      subsamplingRate=subsample, seed=seed),
    }


def fit(df: DataFrame, features: list[str], target: str, estimator, impute: bool = True) -> PipelineModel:
    """Imputation by exact medians (unless the matrix is filled already), vector assembly and the regressor."""
    typed = df.filter(F.col(target).isNotNull()).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("label"))
    filled = [f"{c}__f" for c in features] if impute else features
    stages = [median_filler(typed, features)] if impute else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=filled, outputCol="features"), estimator]).fit(typed)


def median_filler(df: DataFrame, features: list[str]) -> SQLTransformer:
    """A pipeline stage that adds ``<feature>__f``: the feature with its gaps filled by the exact median of ``df``, 0 for a feature without values."""
    medians = fit_medians(df, features).first()
    filled = ", ".join(f"coalesce(nullif(cast(`{c}` as double), cast('NaN' as double)), {0.0 if medians[c] is None else medians[c]!r}D) as `{c}__f`" for c in features)
    return SQLTransformer(statement=f"select *, {filled} from __THIS__")


def forecast_rows(df: DataFrame, target: str = K.TARGET, keys=("station_id",), ts: str = "timestamp_utc", tie=(), test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a forecast, with lags, rolling statistics and leads of the whole series.

    Windows come before the split, so the first test rows look back into the training rows; a window only ever looks back, so no test row is fed from its
    future.  Rows without the first lead are left out; gaps in lags stay, for the training medians to fill (:func:`filled_matrices`).
    """
    windows = series.lag_lead_features(df, target, keys, ts, tie, rolling=True)
    # the split reads its rows several times to find the cut: the windows are worked out once, before it
    known = materialise(windows.filter(F.col(f"target_lead_{K.HORIZON_HOURS[0]}h").isNotNull()), "forecast-rows")
    marked = temporal_split(known, ts, tie, test_share)
    return tuple(marked.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def filled_matrices(fs: FeatureSet, train: DataFrame, test: DataFrame, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Engineered train and test rows, gaps filled with the training medians, written out once."""
    names = [*fs.names, *extra]
    raw = materialise(dealt_evenly(fs.transform(train)), "train")
    medians = materialise(fit_medians(raw, names), "medians")      # one row, read for either table
    def fill(df):
        return with_row_of(df, medians, "_m", now=True).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col("_m")[c], F.lit(0.0)) for c in names}).drop("_m")
    return materialise(fill(raw), "train-filled"), materialise(fill(fs.transform(test)), "test-filled")


def predict(model: PipelineModel, df: DataFrame, features: list[str], low: float | None = 0.0,
            high: float | None = 999.0, out: str = "prediction") -> DataFrame:
    """Align to the model's features, predict and clip."""
    have = set(df.columns)
    filled = df.withColumns({c: (F.col(c).cast("double") if c in have else F.lit(0.0)) for c in features})
    scored = model.transform(filled).drop("features", *[f"{c}__f" for c in features])
    value = F.col("prediction")
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    scored = scored.withColumn("prediction", value)
    return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)


def evaluate(train: DataFrame, test: DataFrame, features: list[str], target: str, estimator, name: str,
             folds: int = 5) -> DataFrame:
    """Station-grouped cross-validation on the training rows (with their folds) plus holdout
    scores: one row.  The matrices are filled."""
    def scored(rows: DataFrame, held: DataFrame, part: str) -> DataFrame:
        model = fit(rows, features, target, estimator.copy(), impute=False)
        return materialise(regression_metrics(predict(model, held, features, None, None), target, "prediction"), f"{name}-{part}")

    jobs = [partial(scored, train.filter(F.col("fold") != k), train.filter(F.col("fold") == k), f"fold-{k}") for k in range(folds)]
    # the driver holds the trees of a model while it is fitted and scored: of deep forests, one at a time
    at_once = 1 if isinstance(estimator, RandomForestRegressor) else AT_ONCE
    *scores, holdout = side_by_side(train.sparkSession, [*jobs, partial(scored, train, test, "holdout")], at_once)
    cv = reduce(DataFrame.unionByName, scores).filter(F.col("n") > 0).agg(
        F.avg("mae").alias("cv_mae"), F.avg("rmse").alias("cv_rmse"), F.avg("r2").alias("cv_r2"))
    return with_row_of(holdout, cv, "_cv").select(F.lit(name).alias("model"), F.lit(len(features)).alias("features"),
                                                  F.col("n").alias("test_rows"), "mae", "rmse", "r2", "_cv.*")


def train_baselines(train: DataFrame, test: DataFrame, group: str = "full", target: str = K.TARGET, folds: int = 5,
                    fold_mode: str = "station", **sizes) -> DataFrame:
    """Scores of the three baselines, cross-validated over folds of the named mode; the one with the smallest holdout MAE is marked."""
    fs = FeatureSet(group, keep=["station_id", target]).fit(train)
    x_train, x_test = filled_matrices(fs, train, test)
    dealt = materialise(spatial_kfold(x_train, fold_mode, "station_id", folds), "folds")
    rows = [evaluate(dealt, x_test, fs.names, target, e, n, folds) for n, e in estimators(**sizes).items()]
    table = materialise(reduce(DataFrame.unionByName, rows), "scores")     # read twice: every model predicts once
    best = table.agg(F.min_by("model", "mae").alias("model"))
    return with_row_of(table, best).withColumn("is_best", F.col("model") == F.col("_stats.model")).drop("_stats")


def train_horizons(train: DataFrame, test: DataFrame, lag_columns: list[str], group: str = "full",
                   target: str = K.TARGET, horizons=K.HORIZON_HOURS, rounds: int = 300, step: float = 0.04,
                   depth: int = 6) -> DataFrame:
    """One boosted model per horizon on features and lags, against persistence."""
    leads = [f"target_lead_{h}h" for h in horizons]
    fs = FeatureSet(group, keep=[target, *leads, *lag_columns]).fit(train)
    x_train, x_test = filled_matrices(fs, train, test, lag_columns)
    features = [*fs.names, *lag_columns]

    def scored(h: int, lead: str) -> DataFrame:
        gbt = GBTRegressor(labelCol="label", maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=0.8, seed=42)
        model = fit(x_train, features, lead, gbt, impute=False)
        scores = regression_metrics(predict(model, x_test, features, 0.0, None), lead, "prediction")
        base = persistence_baseline(x_test, target, [h]).select(F.col("mae").alias("persistence_mae"))
        gain = F.when(F.col("persistence_mae") > 0,
                      (F.col("persistence_mae") - F.col("mae")) / F.col("persistence_mae") * 100.0).otherwise(0.0)
        return materialise(with_row_of(scores, base, "_base").select("*", "_base.persistence_mae").select(
            F.lit(h).alias("horizon_hours"), "n", "persistence_mae", "mae", "rmse", "r2",
            (F.col("mae") < F.col("persistence_mae")).alias("beats_persistence"), gain.alias("gain_pct")), f"horizon-{h}")

    return reduce(DataFrame.unionByName, side_by_side(train.sparkSession, [partial(scored, *pair) for pair in zip(horizons, leads)]))


def ablation(train: DataFrame, test: DataFrame, target: str = K.TARGET, groups=("weather_only", "weather_gis", "full"),
             rounds: int = 300, step: float = 0.05, depth: int = 6) -> DataFrame:
    """Holdout scores of the boosted model per feature group and the gain over the first group.

    A feature's values do not depend on the group it is asked for in, so a group whose features all stand in a wider one's matrices reads those.
    """
    made = []
    sets = [FeatureSet(group, keep=[target]) for group in groups]
    for fs in sorted(sets, key=lambda fs: -len(K.FEATURE_GROUPS[fs.group])):
        wide = next((w for w, _ in made if set(fs.columns(train)) <= set(w.columns(train))), None)
        fs.fit(train, wide.medians if wide else None)
        if wide is None:
            made.append((fs, filled_matrices(fs, train, test)))

    def scored(position: int, group: str, fs: FeatureSet) -> DataFrame:
        gbt = GBTRegressor(labelCol="label", maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=0.8, seed=42)
        x_train, x_test = next(matrices for w, matrices in made if set(fs.names) <= set(w.names))
        model = fit(x_train, fs.names, target, gbt, impute=False)
        scores = regression_metrics(predict(model, x_test, fs.names, None, None), target, "prediction")
        return materialise(scores.select(F.lit(position).alias("position"), F.lit(group).alias("feature_group"),
                                         F.lit(len(fs.names)).alias("features"), "n", "mae", "rmse", "r2"), f"group-{position}")

    rows = side_by_side(train.sparkSession, [partial(scored, i, *pair) for i, pair in enumerate(zip(groups, sets))])
    table = materialise(reduce(DataFrame.unionByName, rows), "scores")
    first = table.agg(F.min_by("mae", "position").alias("mae"))
    return (with_row_of(table, first)
            .withColumn("mae_gain_pct", F.when(F.col("_stats.mae") > 0, (F.col("_stats.mae") - F.col("mae"))
                                               / F.col("_stats.mae") * 100.0).otherwise(0.0)).drop("_stats"))


def forecast_defaults(df: DataFrame, prediction: str = "prediction", target: str = K.TARGET) -> DataFrame:
    """Lag inputs a point lacks: the current prediction, and 10 for the rolling deviation."""
    new = {f"{target}_lag_{k}h": F.col(prediction) for k in K.LAG_HOURS}
    new |= {f"{target}_rolling_mean_6h": F.col(prediction), f"{target}_rolling_mean_24h": F.col(prediction),
            f"{target}_rolling_std_24h": F.lit(10.0)}
    have = set(df.columns)
    return df.withColumns({c: v for c, v in new.items() if c not in have})


def batch_score(model: PipelineModel, features: FeatureSet, df: DataFrame) -> DataFrame:
    """Engineer, align, predict and clip a whole table."""
    return predict(model, features.transform(df), features.names)

"""Exploratory aggregates: distributions, bins, correlations, composites."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline import constants as K
from smogline.functions import aqi, clock
from smogline.operators.common import count_if, null_safe_join, unpivot, with_row_of
from smogline.operators.quantiles import around, exact_quantiles, interpolated, long_quantiles


def daily_mean_complete(df: DataFrame, value: str = "pm25", ts: str = "timestamp_utc", by=(),
                        minimum: int = 12) -> DataFrame:
    """Mean per local date, only for dates with at least ``minimum`` readings."""
    return (df.withColumn("date", F.to_date(clock.to_local(F.col(ts))))
            .groupBy(*by, "date").agg(F.avg(value).alias("_mean"), F.count(value).alias("measurements"))
            .filter(F.col("measurements") >= minimum)
            .select(*by, "date", F.bround("_mean", 2).alias(value), "measurements"))


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    long = unpivot(df, [], columns, "column", "value").filter(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = long_quantiles(long, ["column"], "value", [interpolated(p) for p in (0.25, 0.5, 0.75)], around([0.25, 0.5, 0.75]))
    return moments.join(quartiles, "column").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


# What to do about gaps, by the role a column plays.
GAP_POLICY = {
    "label": "leave out of training", "retrieval": "add a gap flag", "weather": "fill short gaps in time",
    "geography": "constant or median", "other": "look at it first",
}


def column_role(column: str) -> str:
    """Role of a column in the fused table: label, retrieval (satellite), weather, geography or other."""
    if column == K.TARGET or column in K.FORBIDDEN_COLUMNS:
        return "label"
    if column in K.SATELLITE_COLUMNS or column.startswith("satellite_"):
        return "retrieval"
    if column in K.WEATHER_COLUMNS:
        return "weather"
    return "geography" if column in K.STATIC_COLUMNS else "other"


def missing_strategy(column: str) -> str:
    """Recommended handling of a column's gaps."""
    return GAP_POLICY[column_role(column)]


def missingness_profile(df: DataFrame) -> DataFrame:
    """Null count, percentage and strategy per column, from one pass."""
    names = df.columns
    counted = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    table = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
                               F.lit(missing_strategy(c)).alias("strategy")) for i, c in enumerate(names)])
    share = F.bround(F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("_n")), F.lit(0.0)), 2)
    return (counted.select("_n", F.inline(table))
            .select("column", "missing_count", share.alias("missing_pct"), "strategy"))


def missing_by_group(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Share of missing values per group, in percent."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[
        (F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(f"{c}_missing_pct") for c in columns])


def group_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median per group and the ratio of the highest to the lowest median."""
    medians = exact_quantiles(df.filter(F.col(by).isNotNull()), [by], [value], [0.5]).select(
        F.col(by), F.col(f"{value}_p50").alias("median"))
    span = medians.agg(F.max("median").alias("hi"), F.min("median").alias("lo"))
    return (with_row_of(medians, span)
            .select(by, "median", (F.col("_stats.hi") / F.greatest(F.col("_stats.lo"), F.lit(0.1))).alias("ratio"),
                    (F.col("median") == F.col("_stats.hi")).alias("is_highest"),
                    (F.col("median") == F.col("_stats.lo")).alias("is_lowest")))


def station_median_map(df: DataFrame, value: str, lat="latitude", lon="longitude") -> DataFrame:
    """Median per position and the 95th percentile of the medians as color cap."""
    medians = exact_quantiles(df, [lat, lon], [value], [0.5]).select(
        lat, lon, F.col(f"{value}_p50").alias("median"))
    cap = exact_quantiles(medians, [], ["median"], [0.95])
    return with_row_of(medians, cap, now=True).select(lat, lon, "median", F.col("_stats.median_p95").alias("color_cap"))


def hourly_profile(df: DataFrame, value: str, ts: str = "timestamp_utc") -> DataFrame:
    """Mean and ±1 deviation band per hour of day; the hour with the highest mean is marked."""
    hours = df.groupBy(F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    peak = hours.agg(F.max_by("hour", F.struct("mean", -F.col("hour"))).alias("hour"))
    return with_row_of(hours, peak).select(
        "hour", "mean", "std", (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"), (F.col("hour") == F.col("_stats.hour")).alias("is_peak"))


WIND_BINS = [0, 1, 2, 3, 5, 8, 12, 100]


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the interval (edge, next edge] a value lies in, else null."""
    ladder = F.when(value <= edges[0], F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        ladder = ladder.when(value <= edge, F.lit(i))
    return ladder


def binned_median(df: DataFrame, x: str, y: str, edges=WIND_BINS) -> DataFrame:
    """Median of y per right-closed bin of x."""
    binned = df.withColumn("bin", right_closed_bin(F.col(x), list(edges))).filter(F.col("bin").isNotNull())
    return exact_quantiles(binned, ["bin"], [y], [0.5]).select("bin", F.col(f"{y}_p50").alias("median"))


def quantile_bin(value: Column, edges: list[Column]) -> Column:
    """0-based bin by inner edges; a value on an edge belongs to the lower bin."""
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + (value > e).cast("int")
    return F.when(value.isNotNull(), bin_)


def quartile_median(df: DataFrame, x: str, y: str) -> DataFrame:
    """Median of y per quartile of x (edges interpolated on the values)."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    edges = exact_quantiles(pairs, [], [x], [0.25, 0.5, 0.75])
    binned = with_row_of(pairs, edges, now=True).withColumn("quartile", 1 + quantile_bin(
        F.col(x), [F.col(f"_stats.{x}_p{p}") for p in (25, 50, 75)]))
    out = exact_quantiles(binned, ["quartile"], [y], [0.5])
    return out.select("quartile", F.col(f"{y}_p50").alias("median"))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.6, "Strong").when(F.abs(r) > 0.4, "Moderate").otherwise("Weak")


def pair_correlation_ols(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Pearson r, least-squares line and strength of each x against y (complete pairs)."""
    aggregates = []
    for x in xs:
        pair = F.col(x).isNotNull() & F.col(y).isNotNull()
        px, py = F.when(pair, F.col(x)), F.when(pair, F.col(y))
        aggregates.append(F.struct(F.lit(x).alias("feature"), F.corr(px, py).alias("r"),
                                   F.regr_slope(py, px).alias("slope"), F.regr_intercept(py, px).alias("intercept"),
                                   count_if(pair).alias("n")))
    return (df.agg(F.array(*aggregates).alias("t")).select(F.inline("t"))
            .withColumn("strength", strength(F.col("r"))))


def correlation_matrix(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson r of all column pairs in one pass; pairs with the target carry their rank by \\|r\\|."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"))
             for a, b in combinations(columns, 2)]
    pairs = df.agg(F.array(*cells).alias("t")).select(F.inline("t"))
    with_target = (F.col("a") == target) | (F.col("b") == target)
    order = Window.partitionBy(with_target).orderBy(F.abs("r").desc_nulls_last(), "a", "b")   # columns² rows
    return pairs.withColumn("target_rank", F.when(with_target, F.row_number().over(order)))


def distribution_stats(df: DataFrame, value: str, threshold: float = 60.0) -> DataFrame:
    """Sample skewness, mean, median and the share above a threshold."""
    n = F.count(value).cast("double")
    adjusted = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    basic = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), adjusted.alias("skewness"),
                   (F.avg((F.col(value) > threshold).cast("double")) * 100.0).alias("above_pct"))
    return (with_row_of(basic, exact_quantiles(df, [], [value], [0.5]))
            .select("n", "mean", F.col(f"_stats.{value}_p50").alias("median"), "skewness", "above_pct"))


def _equal_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / bins
    return F.least(F.floor(F.try_divide(value - low, width)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """Counts of equal-width bins between minimum and maximum (the top edge counts)."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    known = with_row_of(df.filter(F.col(value).isNotNull()).select(value), span)
    return (known.groupBy(_equal_bin(F.col(value), F.col("_stats.lo"), F.col("_stats.hi"), bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("count")))


def density_2d(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Row counts of a square grid over two variables; empty cells are left out."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    span = pairs.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    s = F.col("_stats")
    return (with_row_of(pairs, span)
            .groupBy(_equal_bin(F.col(x), s["x0"], s["x1"], bins).alias("x_bin"),
                     _equal_bin(F.col(y), s["y0"], s["y1"], bins).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("count")))


OUTLIER_PERCENTILES = [0.9, 0.95, 0.99, 0.995, 0.999]


def iqr_outliers(df: DataFrame, value: str) -> DataFrame:
    """Outlier limits (1.5 and 3 IQR above the upper quartile) and counts above them and above
    the upper percentiles."""
    edges = exact_quantiles(df, [], [value], [0.25, 0.75, *OUTLIER_PERCENTILES])
    q = {p: F.col(f"_stats.{value}_p{format(p * 100, 'g').replace('.', '_')}") for p in [0.25, 0.75, *OUTLIER_PERCENTILES]}
    iqr = q[0.75] - q[0.25]
    rows = with_row_of(df.select(value), edges).select(
        F.col(value).alias("v"), (q[0.75] + 1.5 * iqr).alias("outlier_threshold"),
        (q[0.75] + 3.0 * iqr).alias("extreme_threshold"), *[q[p].alias(f"q{i}") for i, p in enumerate(OUTLIER_PERCENTILES)])
    above = {f"above_p{format(p * 100, 'g').replace('.', '_')}": count_if(F.col("v") > F.col(f"q{i}"))
             for i, p in enumerate(OUTLIER_PERCENTILES)}
    return rows.agg(F.max("outlier_threshold").alias("outlier_threshold"),
                    F.max("extreme_threshold").alias("extreme_threshold"),
                    count_if(F.col("v") > F.col("outlier_threshold")).alias("outliers"),
                    count_if(F.col("v") > F.col("extreme_threshold")).alias("extremes"),
                    *[c.alias(n) for n, c in above.items()])


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature with the target over quantile bins.

    Only rows where every column is known take part; features are ranked.
    """
    columns = [*features, target]
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(complete, [], columns, probs)
    def binned(c):
        return quantile_bin(F.col(c), [F.col(f"_stats.{c}_p{format(p * 100, 'g').replace('.', '_')}") for p in probs])
    coded = with_row_of(complete, edges).select(
        binned(target).alias("tb"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("fb")) for f in features])))
    joint = coded.groupBy("feature", "fb", "tb").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # at most bins x bins rows per feature from here on
    w = Window.partitionBy("feature")
    n, cx, cy = F.sum("c").over(w), F.sum("c").over(w.partitionBy("feature", "fb")), F.sum("c").over(w.partitionBy("feature", "tb"))
    terms = joint.select("feature", (F.col("c") / n * F.log(F.col("c") * n / (cx * cy))).alias("term"))
    scores = terms.groupBy("feature").agg(F.sum("term").alias("mi"))
    return scores.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.bround("mi", 9).desc(), "feature")))


def composite_median(df: DataFrame, by: list[str], value: str, qa: Column | None = None, scale: float = 1.0) -> DataFrame:
    """Median of quality-masked, scaled values per group, with the number of valid and all pixels."""
    valid = F.col(value) * scale if qa is None else F.when(qa, F.col(value) * scale)
    masked = df.withColumn("_v", valid)
    counts = masked.groupBy(*by).agg(F.count("_v").alias("pixel_count"), F.count(F.lit(1)).alias("all_pixels"))
    medians = exact_quantiles(masked, by, ["_v"], [0.5]).withColumnRenamed("_v_p50", "median")
    return null_safe_join(counts, medians, by, "left")


def composite_daily_mean(df: DataFrame, value: str, by=(), ts="timestamp_utc", scale: float = 0.001) -> DataFrame:
    """Daily mean over the granules of a place, scaled."""
    return (df.groupBy(*by, F.to_date(ts).alias("date"))
            .agg((F.avg(value) * scale).alias("mean"), F.count(value).alias("granules")))


# ---- model scores ---------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """MAE, RMSE and R² over rows where both values are known."""
    known = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(F.lit(1))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(error * error), total)).alias("r2"))


def bias_category_accuracy(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """Mean error and the share of rows whose index category is predicted right."""
    known = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    same = aqi.pm25_category(F.col(actual)) == aqi.pm25_category(F.col(predicted))
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                  F.avg(F.col(predicted) - F.col(actual)).alias("bias"),
                                  F.avg(same.cast("double")).alias("category_accuracy"))


def persistence_baseline(df: DataFrame, target: str = K.TARGET, horizons=K.HORIZON_HOURS,
                         model_mae: dict[int, float] | None = None) -> DataFrame:
    """MAE and RMSE of predicting "no change" per horizon (0 when there is nothing to compare),
    and the gain of a model's MAE over it when given."""
    cells = []
    for h in horizons:
        pair = F.col(target).isNotNull() & F.col(f"target_lead_{h}h").isNotNull()
        error = F.when(pair, F.col(f"target_lead_{h}h") - F.col(target))
        mae = F.coalesce(F.avg(F.abs(error)), F.lit(0.0))
        gain = F.lit(None).cast("double") if not model_mae or h not in model_mae else \
            F.when(mae > 0, (mae - F.lit(model_mae[h])) / mae * 100.0).otherwise(0.0)
        cells.append(F.struct(F.lit(h).alias("horizon_hours"), count_if(pair).alias("n"), mae.alias("mae"),
                              F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("rmse"), gain.alias("gain_pct")))
    return df.agg(F.array(*cells).alias("t")).select(F.inline("t"))


def seasonal_naive_baseline(df: DataFrame, target: str, keys=("station_id",), ts="timestamp_utc",
                            season_hours: int = 24) -> DataFrame:
    """Error of predicting the value of the same hour a day before.

    Needs one row per (keys, hour).
    """
    earlier = df.select(*keys, (F.col(ts) + F.expr(f"INTERVAL {season_hours} HOURS")).alias(ts),
                        F.col(target).alias("_before"))
    return regression_metrics(df.join(earlier, [*keys, ts]), target, "_before")


def best_horizon_window(df: DataFrame, by: list[str]) -> DataFrame:
    """Cleanest and worst horizon per location with advice (the first horizon wins ties)."""
    cell = F.struct("horizon_hours", "predicted_pm25", "category")
    best = F.min_by(cell, F.struct("predicted_pm25", "horizon_hours"))
    worst = F.max_by(cell, F.struct("predicted_pm25", -F.col("horizon_hours")))
    h, lo, hi = F.col("_b.horizon_hours"), F.col("_b.predicted_pm25"), F.col("_w.predicted_pm25")
    when = F.when(h > 1, F.format_string("In +%d hour(s)", h)).otherwise("Next 1-2 hours")
    return df.groupBy(*by).agg(best.alias("_b"), worst.alias("_w")).select(
        *by, F.format_string("%s (%s air quality)", when, F.col("_b.category")).alias("recommended_window"),
        lo.alias("lowest_predicted_pm25"), hi.alias("peak_hazard_pm25"),
        F.format_string("+%dh", F.col("_w.horizon_hours")).alias("peak_hazard_horizon"),
        F.format_string("Cleanest air in +%dh (%.1f ug/m3). Avoid strenuous exercise at the peak (+%dh, %.1f ug/m3).",
                        h, lo, F.col("_w.horizon_hours"), hi).alias("advice"))


DISTANCE_BRACKETS = ((5.0, "0-5"), (20.0, "5-20"), (50.0, "20-50"))


def distance_bracket(km: Column) -> Column:
    ladder = F.when(km.isNull(), F.lit(None).cast("string"))
    for upper, name in DISTANCE_BRACKETS:
        ladder = ladder.when(km <= upper, F.lit(name))
    return ladder.otherwise(">50")


def conformal_calibration(df: DataFrame, actual: str, predicted: str, distance: str, is_calibration: Column,
                          alpha: float = 0.1) -> DataFrame:
    """Split-conformal interval: the ⌈(n+1)(1-α)⌉-th smallest absolute residual of the
    calibration rows, widened with distance; coverage and width per bracket on the others."""
    scored = df.withColumn("_res", F.abs(F.col(actual) - F.col(predicted))).filter(F.col("_res").isNotNull())
    def rank(n):
        return F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)), n) - 1
    qhat = long_quantiles(scored.filter(is_calibration), [], "_res", [rank]).select(F.col("q")[0].alias("q"))
    half = F.col("_stats.q") * (1.0 + 0.35 * F.sqrt(F.col(distance) / 10.0))
    held_out = with_row_of(scored.filter(~is_calibration & F.col(distance).isNotNull()), qhat)
    return (held_out.groupBy(distance_bracket(F.col(distance)).alias("bracket"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("_stats.q").alias("qhat"),
                 (F.avg((F.col("_res") <= half).cast("double")) * 100.0).alias("coverage_pct"),
                 F.avg(2.0 * half).alias("mean_width")))

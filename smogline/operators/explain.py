"""Contributions of a linear model and what is told about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smogline import constants as K
from smogline.functions import aqi, clock
from smogline.operators.common import with_row_of


def driver_name(feature: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.DRIVER_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, feature), feature)


def feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in features])


def contributions_array(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0,
                        means: DataFrame | None = None) -> DataFrame:
    """Adds ``contributions`` (coef·(x - mean) per feature; a missing x counts as its mean) and
    ``base_value`` (the prediction at the means)."""
    names = list(coefficients)
    row = means if means is not None else feature_means(df, names)
    out = with_row_of(df, row, "_mean")
    def one(c):
        part = F.coalesce((F.col(c) - F.col("_mean")[c]) * F.lit(coefficients[c]), F.lit(0.0))
        return F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), part.alias("contribution"),
                        F.lit(K.DRIVER_NAMES.get(c, c)).alias("driver"))
    base = sum((F.lit(coefficients[c]) * F.col("_mean")[c] for c in names[1:]),
               F.lit(coefficients[names[0]]) * F.col("_mean")[names[0]]) + intercept
    return out.withColumns({"base_value": base, "contributions": F.array(*[one(c) for c in names])}).drop("_mean")


def linear_contributions(df: DataFrame, keys: list[str], coefficients: dict[str, float], intercept: float = 0.0,
                         means: DataFrame | None = None) -> DataFrame:
    """One row per instance and feature."""
    made = contributions_array(df, coefficients, intercept, means)
    return made.select(*keys, "base_value", F.inline("contributions")).drop("driver")


def topk(contributions: Column, k: int) -> Column:
    """The k strongest contributions of a row (first listed wins ties); no shuffle needed."""
    ranked = F.array_sort(F.transform(contributions, lambda c, i: F.struct(
        (-F.abs(c["contribution"])).alias("w"), i.alias("i"), c.alias("c"))))
    return F.slice(F.transform(ranked, lambda r: r["c"]), 1, k)


def topk_contributions(df: DataFrame, keys: list[str], coefficients: dict[str, float], k: int = 6,
                       means: DataFrame | None = None) -> DataFrame:
    """One row per instance and rank."""
    made = contributions_array(df, coefficients, 0.0, means)
    return (made.select(*keys, F.posexplode(topk(F.col("contributions"), k)).alias("at", "c"))
            .select(*keys, (F.col("at") + 1).alias("rank"), "c.feature", "c.value", "c.contribution"))


def global_importance(df: DataFrame, coefficients: dict[str, float], means: DataFrame | None = None) -> DataFrame:
    """Mean absolute contribution per feature, ranked.  One pass: features are columns."""
    names = list(coefficients)
    row = means if means is not None else feature_means(df, names)
    sized = with_row_of(df, row, "_mean").agg(*[
        F.avg(F.coalesce(F.abs((F.col(c) - F.col("_mean")[c]) * F.lit(coefficients[c])), F.lit(0.0))).alias(c)
        for c in names])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("w"), F.lit(c).alias("feature")) for c in names]))
    return sized.select(F.posexplode(ranked).alias("at", "f")).select(
        F.col("f.feature").alias("feature"), (-F.col("f.w")).alias("importance"), (F.col("at") + 1).alias("rank"))


def forecast_table(df: DataFrame, keys: list[str], horizons: dict[int, Column], ts: str = "timestamp_utc") -> DataFrame:
    """One row per location and horizon: target time, PM2.5, index, category, color."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.greatest(v, F.lit(0.0)).alias("_v"))
                      for h, v in horizons.items()])
    out = df.select(*keys, F.col(ts).alias("_t"), F.inline(cells))
    index = aqi.pm25_index(F.col("_v"))
    return out.select(*keys, "horizon_hours", F.bround("_v", 1).alias("predicted_pm25"), index.alias("predicted_aqi"),
                      aqi.category(index).alias("category"), aqi.color_of_index(index).alias("color"),
                      clock.from_micros(clock.micros(F.col("_t")) + F.col("horizon_hours") * F.lit(3_600_000_000))
                      .alias("target_time"))

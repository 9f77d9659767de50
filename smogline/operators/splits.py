"""Train/test splits and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline.operators import selection
from smogline.operators.common import null_safe_join, with_row_of
from smogline.operators.quantiles import exact_quantiles


def split_by_date(df: DataFrame, date: str, ts: str = "timestamp_utc") -> DataFrame:
    """Marks rows before the date "train", the others "test"."""
    return df.withColumn("split", F.when(F.col(ts) < F.lit(date).cast("timestamp_ntz"), "train").otherwise("test"))


def temporal_split(df: DataFrame, ts: str = "timestamp_utc", tie=(), test_share: float = 0.2) -> DataFrame:
    """The first int(n·(1-share)) rows in time order are "train", the rest "test".

    Rows without a time come last; equal times go by the tie columns (nulls first), then by all columns.  The cut is found by counting rows per
    range, first of time, then of the rows at the cut's time (:mod:`smogline.operators.selection`), so one time stamp may hold all rows.
    """
    cut = math.floor(df.count() * (1.0 - test_share))
    return selection.mark_first(df, ts, list(tie), cut, "_first").withColumn("split", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def _fold_of_groups(sizes: DataFrame, group: str, most: int) -> DataFrame:
    """Deal groups to folds from the largest down, forwards and backwards in turn; never more folds than groups."""
    sizes = with_row_of(sizes, sizes.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("folds")), "_all")
    folds = F.col("_all.folds")
    # one row per group; ranked inside groups of equal size, shifted by the larger ones
    ties = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_same"))
    larger = ties.select("_n", F.coalesce(F.sum("_same").over(
        Window.orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_larger"))
    rank = F.col("_larger") + F.row_number().over(Window.partitionBy("_n").orderBy(group)) - 1
    lap, place = F.floor(F.col("_rank") / folds), F.pmod(F.col("_rank"), folds)
    return (sizes.join(larger, "_n").withColumn("_rank", rank)
            .select(group, F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold")))


def group_kfold(df: DataFrame, group: str = "station_id", folds: int = 5) -> DataFrame:
    """Adds ``fold``: all rows of a station share one fold, folds are balanced by size.

    With fewer stations than ``folds`` there are as many folds as stations.  A missing station counts as one group of its own.
    """
    named = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("station_unassigned")))
    sizes = named.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    return named.join(_fold_of_groups(sizes, "_g", folds), "_g").drop("_g")


def latitude_kfold(df: DataFrame, folds: int = 5, lat: str = "latitude") -> DataFrame:
    """Fallback without stations: folds are latitude quantile bins."""
    probs = [i / folds for i in range(1, folds)]
    edges = exact_quantiles(df, [], [lat], probs)
    fold = F.lit(0)
    for p in probs:
        fold = fold + F.coalesce(F.col(lat) > F.col(f"_stats.{lat}_p{format(p * 100, 'g').replace('.', '_')}"),
                                 F.lit(False)).cast("int")
    return with_row_of(df, edges).withColumn("fold", fold).drop("_stats")


def row_kfold(df: DataFrame, folds: int = 5) -> DataFrame:
    """Last fallback: rows dealt by a hash of their content."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*df.columns), F.lit(folds)).cast("int"))


FOLD_MODES = ("station", "latitude", "row")


def spatial_kfold(df: DataFrame, mode: str, group: str = "station_id", folds: int = 5) -> DataFrame:
    """Folds by ``mode``: "station" (two stations at least), "latitude" (five latitudes at least) or "row".

    The caller names the mode; a table it does not fit raises ValueError instead of being split another way.
    """
    if mode not in FOLD_MODES:
        raise ValueError(f"mode must be one of {FOLD_MODES}")
    least = {"station": (group, 2), "latitude": ("latitude", 5)}.get(mode)
    if least:
        column, wanted = least
        found = df.select(column).dropna().distinct().limit(wanted).count() if column in df.columns else 0
        if found < wanted:
            raise ValueError(f"mode {mode} needs {wanted} values of {column}, found {found}")
    return {"station": lambda: group_kfold(df, group, folds), "latitude": lambda: latitude_kfold(df, min(folds, 5)), "row": lambda: row_kfold(df, folds)}[mode]()


def leave_city_out(df: DataFrame, train_cities: list, city: str = "city") -> DataFrame:
    """Rows of the listed cities are "train", all others "test"."""
    inside: Column = F.coalesce(F.col(city).isin(*train_cities), F.lit(False))
    return df.withColumn("split", F.when(inside, "train").otherwise("test"))

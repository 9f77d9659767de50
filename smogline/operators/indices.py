"""Overall index of a table.

The steps are separate columns, so that each sub-index is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from smogline import constants as K
from smogline.functions import aqi
from smogline.operators import cleaning, series
from smogline.operators.common import present


def with_subindices(df: DataFrame, pollutants: list[str] | None = None, table: str = "domain",
                    gap: str = "continuous", suffix: str = "_subindex") -> DataFrame:
    """Adds ``<pollutant>_subindex`` columns."""
    names = pollutants or present(df, K.POLLUTANTS)
    return df.withColumns({f"{p}{suffix}": aqi.subindex(F.col(p), p, table, gap) for p in names})


def with_overall(df: DataFrame, pollutants: list[str] | None = None, table: str = "domain", gap: str = "continuous",
                 min_pollutants: int = 0, digits: int | None = 1, keep_subindices: bool = False) -> DataFrame:
    """Adds aqi, dominant_pollutant, category, color, health_advisory and n_pollutants.

    The index is the largest sub-index; the first pollutant wins a tie.
    ``min_pollutants=3`` applies the official rule: at least that many pollutants,
    one of them particulate matter, or no index.
    """
    names = pollutants or present(df, K.POLLUTANTS)
    out = with_subindices(df, names, table, gap)
    parts = {p: F.col(f"{p}_subindex") for p in names}
    if digits is not None:
        out = out.withColumns({f"{p}_subindex": F.bround(c, digits) for p, c in parts.items()})
    columns = list(parts.values())
    count = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    if min_pollutants:
        matter = [parts[p].isNotNull() for p in ("pm25", "pm10") if p in parts]
        allowed = count >= min_pollutants
        if matter:
            allowed = allowed & (matter[0] | matter[-1])
        best = F.when(allowed, best)
    out = out.withColumns({"aqi": best, "n_pollutants": count})
    value = F.col("aqi")
    dominant = F.when(value.isNull(), F.lit(None).cast("string"))
    for p, c in parts.items():
        dominant = dominant.when(c == value, F.lit(p.upper()))
    out = out.withColumns({
        "dominant_pollutant": dominant, "category": aqi.category(value), "color": aqi.color_of_index(value),
        "health_advisory": F.when(value.isNull(), "No measurements provided.").otherwise(aqi.advisory(value))})
    return out if keep_subindices else out.drop(*[f"{p}_subindex" for p in names])


def clean_station_readings(df: DataFrame, keys=("station_id",), ts: str = "timestamp_utc", tie=(), flat_hours: int = 4) -> DataFrame:
    """Raw station readings to clean ones with their index, in one go.

    Aliases get their standard names, values outside the physical limits and the ``flat_hours``-th and later of equal readings in a row
    go, then every pollutant gets ``<pollutant>_subindex`` by the stations' own breakpoints, and a row aqi_calculated (the largest), dominant_pollutant (the first
    of equals) and aqi_category; all three are null where no pollutant is left.
    """
    named = cleaning.alias_harmonise(df, cleaning.GROUND_ALIASES)
    names = present(named, K.POLLUTANTS)
    bounded = cleaning.mask_physical_bounds(named)
    moving = series.flatline_mask(bounded, names, keys, ts, tie, flat_hours) if set(keys) | {ts} <= set(named.columns) else bounded
    indexed = with_overall(moving, names, "station", "reference", digits=None, keep_subindices=True)
    out = indexed.withColumn("aqi_category", F.when(F.col("aqi").isNotNull(), F.col("category"))).withColumnRenamed("aqi", "aqi_calculated")
    return out.drop("n_pollutants", "category", "color", "health_advisory")

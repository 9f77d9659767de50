"""Data-quality rules, stage counts and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from smogline import constants as K
from smogline.operators.cleaning import parse_timestamp
from smogline.operators.common import count_if, present, with_row_of


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one in every column."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates")))


def quality_rules(df: DataFrame, lat=(18.0, 19.0), lon=(73.0, 75.0), min_rows: int = 1000,
                  max_null_share: float = 0.5, max_offset_minutes: float = 90.0,
                  required=None, bounds=None) -> DataFrame:
    """One row per rule: (rule, bad_rows, passed).

    Row rules are counted in one pass; duplicates need one aggregation of their own.
    """
    have = set(df.columns)
    rules: list[tuple[str, object, object]] = []       # name, bad count, passed
    n = F.count(F.lit(1))
    rules.append(("min_rows", F.greatest(F.lit(min_rows) - n, F.lit(0)), n >= min_rows))
    missing = [c for c in (required or K.REQUIRED_COLUMNS) if c not in have]
    leaked = [c for c in K.FORBIDDEN_COLUMNS if c in have]
    rules.append(("required_columns", F.lit(len(missing)), F.lit(not missing)))
    rules.append(("forbidden_columns", F.lit(len(leaked)), F.lit(not leaked)))

    def add(name, bad):
        counted = count_if(bad)
        rules.append((name, counted, counted == 0))

    for name, limits in (("latitude", lat), ("longitude", lon)):
        if name in have:
            add(f"{name}_bounds", ~F.coalesce(F.col(name).between(*limits), F.lit(False)))
    if "timestamp_utc" in have:
        add("timestamp_readable", parse_timestamp(df, "timestamp_utc").isNull())
    if K.TARGET in have:
        nulls = count_if(F.col(K.TARGET).isNull())
        rules.append(("target_null_share", nulls, nulls <= n * max_null_share))
    for c, limits in (bounds or K.CANONICAL_BOUNDS).items():
        if c in have:
            add(f"{c}_bounds", ~F.col(c).between(*limits))
    if "temporal_offset_minutes" in have:
        add("temporal_offset", F.abs("temporal_offset_minutes") > max_offset_minutes)

    counted = df.agg(*[F.struct(F.lit(name).alias("rule"), bad.cast("long").alias("bad_rows"), ok.alias("passed"))
                       .alias(f"r{i}") for i, (name, bad, ok) in enumerate(rules)])
    d = F.col("_d.duplicates")
    repeated = F.struct(F.lit("duplicates").alias("rule"), d.cast("long").alias("bad_rows"), (d == 0).alias("passed"))
    return with_row_of(counted, duplicate_rows(df), "_d").select(
        F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rules))], repeated)))


def assert_canonical(df: DataFrame, **limits) -> None:
    """Raise when a quality rule fails (duplicates only matter after deduplication)."""
    failed = [f"{r['rule']}: {r['bad_rows']}" for r in quality_rules(df, **limits).filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError("canonical dataset validation failed: " + "; ".join(failed))


def stage_funnel(stages: dict[str, DataFrame], watch: dict[str, list[str]] | None = None,
                 ready_rows: int = 0) -> DataFrame:
    """Per stage: rows, files are left to the source, % missing of watched columns, rows with
    invalid coordinates, and whether the stage is ready (more rows than ``ready_rows``)."""
    watch = watch or {}
    parts = []
    for order, (name, df) in enumerate(stages.items()):
        watched = present(df, watch.get(name, []))
        share = (sum((F.avg(F.col(c).isNull().cast("double")) for c in watched[1:]),
                     F.avg(F.col(watched[0]).isNull().cast("double"))) / len(watched) * 100.0
                 if watched else F.lit(None).cast("double"))
        bad = (count_if(~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)))
               if {"latitude", "longitude"} <= set(df.columns) else F.lit(0).cast("long"))
        parts.append(df.agg(F.lit(order).alias("position"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"),
                            share.alias("missing_pct"), bad.alias("invalid_coords"),
                            (F.count(F.lit(1)) > ready_rows).alias("ready")))
    return reduce(DataFrame.unionByName, parts)


def provenance_manifest(df: DataFrame, by=(), schema_version: str = "1.0.0") -> DataFrame:
    """Row count, parameters, stations, bounds and columns per batch."""
    bounds = [f(F.col(c)).alias(f"{c}_{n}") for c in present(df, ["latitude", "longitude"])
              for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        # the parameter vocabulary is fixed and small
        F.array_join(F.sort_array(F.collect_set("parameter")), ",").alias("parameters"),
        F.count_distinct("station_id").alias("station_count"), *bounds,
        F.lit(",".join(df.columns)).alias("columns"), F.lit(schema_version).alias("schema_version"))


MANIFEST_COLUMNS = ["aod_550nm", "satellite_no2", "satellite_so2", "satellite_co", "satellite_o3",
                    "temperature_2m", K.TARGET]


def canonical_manifest(df: DataFrame) -> DataFrame:
    """Rows, columns and % missing of the watched columns, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), *[
        F.bround(F.avg(F.col(c).isNull().cast("double")) * 100.0, 2).alias(f"missing_{c}_pct")
        for c in present(df, MANIFEST_COLUMNS)])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns a table lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)

"""Scans of Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from smogline import constants as K
from smogline.operators.quality import concat_batches


def scan_parquet_union(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All files of one or more paths or globs; columns missing in a path become null."""
    if isinstance(paths, str):
        paths = [paths]
    return concat_batches([spark.read.option("mergeSchema", "true").parquet(p) for p in paths])


def scan_csv_features(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header row.  Give a schema: inferring types reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def in_region(lat: Column, lon: Column, region: dict = K.REGION) -> Column:
    return lat.between(region["lat_min"], region["lat_max"]) & lon.between(region["lon_min"], region["lon_max"])


def bbox_date_filter(df: DataFrame, start: str, end: str, region: dict = K.REGION, ts="timestamp_utc",
                     lat="latitude", lon="longitude") -> DataFrame:
    """Rows in the bounding box with start <= time < end; pushed to the scan for stored columns."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
                     & in_region(F.col(lat), F.col(lon), region))


CATALOGUE_SCHEMA = ("id string, name string, name_mr string, name_hi string, district string, division string, "
                    "region string, lat double, lon double, population bigint, tier int, emission_profile string")


def location_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """District or town catalogue kept as a CSV next to the data."""
    return scan_csv_features(spark, path, CATALOGUE_SCHEMA)

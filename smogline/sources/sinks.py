"""Writers: daily partitions and GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def daily_parquet(df: DataFrame, path: str, ts: str = "timestamp_utc", rows_per_file: int = 20_000_000) -> None:
    """One directory per date; only the dates present are replaced.

    Rows are rebalanced by date: small dates share a task, a busy date is split
    over many.
    """
    dated = df.withColumn("date", F.to_date(ts)).hint("rebalance", "date")
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(path))


def geojson_feature(value: Column, pm25: Column, uncertainty: Column, reliability: Column,
                    grid_id: Column, lat: Column, lon: Column) -> Column:
    """A GeoJSON Point feature as text; uncertainty defaults to 12.5 and reliability to 85."""
    shown = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double")).alias("coordinates"))
        .alias("geometry"),
        F.struct(grid_id.cast("string").alias("grid_id"), shown.alias("value"),
                 F.coalesce(pm25.cast("double"), shown).alias("pm25"),
                 F.coalesce(uncertainty.cast("double"), F.lit(12.5)).alias("uncertainty"),
                 F.coalesce(reliability.cast("double"), F.lit(85.0)).alias("reliability"),
                 lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude")).alias("properties")))


def geojson_rows(df: DataFrame, value: str = "pm25_pred") -> DataFrame:
    """One ``feature`` text per grid row."""
    have = set(df.columns)
    def col(name):
        return F.col(name) if name in have else F.lit(None)
    return df.select(geojson_feature(col(value), col("pm25_pred"), col("uncertainty"), col("reliability"),
                                     F.coalesce(col("grid_id").cast("string"), F.lit("")), F.col("latitude"),
                                     F.col("longitude")).alias("feature"))


def geojson_lines(df: DataFrame, path: str, value: str = "pm25_pred") -> None:
    """Newline-delimited GeoJSON, written by all tasks."""
    geojson_rows(df, value).write.mode("overwrite").text(path)

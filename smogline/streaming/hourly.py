"""Hourly station indices and data freshness as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline import constants as K
from smogline.operators.cleaning import mask_physical_bounds
from smogline.operators.indices import with_overall

OBSERVED = K.POLLUTANTS


def read_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder whose names match a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hourly_indices(readings: DataFrame, delay: str = "2 hours", pollutants=OBSERVED,
                   record_id: str = "record_id") -> DataFrame:
    """Long readings (station_id, timestamp_utc, parameter, value) to hourly station indices.

    Works on streams and on batches: late rows are dropped after ``delay`` on a
    stream; every record counts once; the mean of an hour feeds the index.
    """
    ladder = F.lit(False)
    for p in pollutants:
        low, high = K.POLLUTANT_LIMITS[p]
        ladder = ladder | ((F.col("parameter") == p) & F.col("value").between(low, high))
    timed = readings.withColumn("event_time", F.col("timestamp_utc").cast("timestamp"))
    valid = timed.filter(F.col("station_id").isNotNull() & F.col("event_time").isNotNull() & ladder)
    if readings.isStreaming:
        once = valid.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([record_id])
    else:
        once = valid.dropDuplicates([record_id])
    hourly = once.groupBy(F.window("event_time", "1 hour").alias("w"), "station_id").agg(
        *[F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in pollutants],
        F.count(F.lit(1)).alias("readings"))
    masked = mask_physical_bounds(hourly)
    return with_overall(masked, list(pollutants)).select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"), "station_id", "readings", *pollutants,
        "aqi", "dominant_pollutant", "category")


def run_hourly(readings: DataFrame, out: str, checkpoint: str, **options) -> None:
    """Process what is there and append the closed hours to a Parquet table."""
    query = (hourly_indices(readings, **options).writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def freshness(readings: DataFrame) -> DataFrame:
    """Last reading per station."""
    timed = readings.withColumn("event_time", F.col("timestamp_utc").cast("timestamp"))
    return timed.groupBy("station_id").agg(F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("readings"))


def run_freshness(readings: DataFrame, out: str, checkpoint: str) -> None:
    """Write each batch's updated stations under its batch number; a replayed batch
    replaces itself."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (freshness(readings).writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def freshness_table(updates: DataFrame, as_of: DataFrame, stale_minutes: float = 120.0) -> DataFrame:
    """Newest update per station with its age at ``as_of`` (one row, column ``t``) and a stale flag."""
    newest = updates.groupBy("station_id").agg(F.max("last_seen").alias("last_seen"))
    age = (F.unix_micros(as_of.select("t").scalar()) - F.unix_micros("last_seen")) / 60e6
    return newest.select("station_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
                         age.alias("age_minutes"), (age > stale_minutes).alias("is_stale"))

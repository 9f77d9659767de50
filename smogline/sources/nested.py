"""Nested API records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MEASUREMENTS = ("struct<results:array<struct<value:string,period:struct<datetimeFrom:struct<utc:string>>,"
                "datetime:string>>>")
STATIONS = ("struct<results:array<struct<id:string,name:string,city:string,country:struct<code:string>,"
            "provider:struct<name:string>,coordinates:struct<latitude:double,longitude:double>,"
            "datetimeFirst:struct<utc:string>,datetimeLast:struct<utc:string>>>>")


def flatten_measurements(df: DataFrame, body: str, keep: list[str] = ()) -> DataFrame:
    """One row per measurement of a JSON body; unreadable numbers and times become null.

    The time is ``period.datetimeFrom.utc``, else ``datetime``.
    """
    parsed = df.withColumn("_b", F.from_json(F.col(body), MEASUREMENTS))
    rows = parsed.select(*keep, F.explode("_b.results").alias("m"))
    time = F.coalesce(F.col("m.period.datetimeFrom.utc"), F.col("m.datetime"))
    return rows.select(*keep, F.expr("try_cast(m.value AS double)").alias("value"),
                       F.try_to_timestamp(time).cast("timestamp_ntz").alias("timestamp_utc"))


def flatten_stations(df: DataFrame, body: str, keep: list[str] = (), default_city: str = "Pune",
                     default_country: str = "IN") -> DataFrame:
    """One row per station of a JSON body with defaults for missing fields."""
    parsed = df.withColumn("_b", F.from_json(F.col(body), STATIONS))
    s = F.col("s")
    return parsed.select(*keep, F.explode("_b.results").alias("s")).select(
        *keep, F.coalesce(s["id"], F.lit("")).alias("station_id"), F.coalesce(s["name"], F.lit("")).alias("station_name"),
        F.coalesce(s["city"], F.lit(default_city)).alias("city"),
        F.coalesce(s["country"]["code"], F.lit(default_country)).alias("country"),
        s["provider"]["name"].alias("provider"), s["coordinates"]["latitude"].alias("latitude"),
        s["coordinates"]["longitude"].alias("longitude"), s["datetimeFirst"]["utc"].alias("first_seen"),
        s["datetimeLast"]["utc"].alias("last_seen"))


def recent_stations(stations: DataFrame, last_seen: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Stations by their last reading, newest first."""
    out = stations.orderBy(F.col(last_seen).desc_nulls_last(), *order)
    return out.limit(limit) if limit else out

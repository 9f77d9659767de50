"""Time keys: hour rounding, local time parts, seasons, overpass windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from smogline import constants as K

HOUR = 3600
_MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / float(_MICROS)


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long")).cast("timestamp_ntz")


def time_chunk(ts: Column, width_seconds: int) -> Column:
    """Index of the fixed-width time slice a timestamp falls in."""
    return F.floor(micros(ts) / F.lit(width_seconds * _MICROS)).cast("long")


def round_to_hour(ts: Column) -> Column:
    """Nearest hour; a half hour goes to the even hour."""
    step = HOUR * _MICROS
    whole = F.floor(micros(ts) / F.lit(step)).cast("long")
    rest = micros(ts) - whole * step
    up = (rest > step // 2) | ((rest == step // 2) & (F.pmod(whole, F.lit(2)) == 1))
    return from_micros((whole + up.cast("long")) * step)


def trunc_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def to_local(ts: Column) -> Column:
    """UTC to local wall-clock time."""
    return from_micros(micros(ts) + K.LOCAL_OFFSET_MINUTES * 60 * _MICROS)


def local_minute_of_day(ts: Column) -> Column:
    local = to_local(ts)
    return F.hour(local) * 60 + F.minute(local)


def season(month: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, months in K.SEASONS.items():
        ladder = ladder.when(month.isin(*months), F.lit(name))
    return ladder


def overpass(ts: Column) -> Column:
    """Name of the overpass window a time falls in (ends included), else null."""
    minute = F.pmod(seconds(to_local(ts)) / 60.0, F.lit(1440.0))
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (start, end) in K.OVERPASS_MINUTES.items():
        ladder = ladder.when(minute.between(start, end), F.lit(name))
    return ladder

"""Weather and satellite unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high]; a missing value stays missing."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def within(value: Column, low: float, high: float) -> Column:
    """The value if it lies in [low, high], else null."""
    return F.when(value.between(low, high), value)


def celsius(value: Column, threshold: float = 150.0) -> Column:
    return F.when(value > threshold, value - 273.15).otherwise(value)


def hectopascal(value: Column, threshold: float = 2000.0) -> Column:
    return F.when(value > threshold, value / 100.0).otherwise(value)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """Direction the wind comes from, degrees from north in [0, 360); calm air reads 180."""
    angle = F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))
    return F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(angle)


def wind_toward(u: Column, v: Column) -> Column:
    """Direction the wind blows to, degrees from north in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def humidity(temp_c: Column, dewpoint_c: Column) -> Column:
    """Relative humidity (%) by the August-Roche-Magnus formula, clipped to [0, 100]."""
    def saturation(t):
        return 17.625 * t / (243.04 + t)
    return clip(100.0 * F.exp(saturation(dewpoint_c) - saturation(temp_c)), 0.0, 100.0)


def humidity_linear(temp: Column, dewpoint: Column) -> Column:
    """The one-term approximation used by the daily reanalysis composites."""
    return 100.0 * F.exp((dewpoint - temp) * (17.67 / 243.5))


def aod_surface_proxy(aod: Column, pblh: Column, rh: Column, scale: float = 1.0) -> Column:
    """AOD / PBLH times the hygroscopic growth factor; null for PBLH = 0 or RH >= 100."""
    growth = F.pow(1.0 - rh / 100.0, F.lit(-0.25))
    return F.when((pblh != 0) & (rh < 100), scale * F.try_divide(aod, pblh) * growth)

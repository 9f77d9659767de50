"""National air-quality index as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from smogline import constants as K


def _measured(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def subindex(value: Column, pollutant: str, table: str = "domain", gap: str = "continuous") -> Column:
    """Piecewise-linear sub-index in [0, 500]; null when the value is missing or negative.

    ``gap="continuous"`` puts a value that lies between two brackets at the foot
    of the upper one.  ``gap="reference"`` leaves the published gaps open: the
    domain table then yields 0 and the station table 500.
    """
    brackets = (K.BREAKPOINTS if table == "domain" else K.STATION_BREAKPOINTS)[pollutant]
    value = value.cast("double")
    top = brackets[-1][1]
    ladder = F.when(~_measured(value), F.lit(None).cast("double"))
    for low, high, index_low, index_high in brackets:
        slope = (index_high - index_low) / (high - low)
        if gap == "continuous":
            inside, position = value <= high, F.greatest(value, F.lit(low)) - low
        else:
            inside, position = value.between(low, high), value - low
        ladder = ladder.when(inside, F.lit(float(index_low)) + F.lit(slope) * position)
    in_gap = 0.0 if table == "domain" else 500.0
    return ladder.when(value > top, F.lit(500.0)).otherwise(F.lit(in_gap))


def _by_index(index: Column, pick: int, missing) -> Column:
    ladder = F.when(index.isNull() | F.isnan(index), F.lit(missing))
    for entry in K.CATEGORIES[:-1]:
        ladder = ladder.when(index <= entry[0], F.lit(entry[pick]))
    return ladder.otherwise(F.lit(K.CATEGORIES[-1][pick]))


def category(index: Column, rounding: bool = True) -> Column:
    """Category name.  With ``rounding`` the index is first rounded half-even to a
    whole number (and a missing index is "Unknown"); without, thresholds apply to
    the raw index and a missing index stays null."""
    if rounding:
        return _by_index(F.bround(index.cast("double"), 0), 1, K.UNKNOWN_CATEGORY[0])
    return _by_index(index.cast("double"), 1, None)


def advisory(index: Column) -> Column:
    return _by_index(F.bround(index.cast("double"), 0), 3, K.UNKNOWN_CATEGORY[2])


def color_of_index(index: Column) -> Column:
    return _by_index(F.bround(index.cast("double"), 0), 2, K.UNKNOWN_CATEGORY[1])


def color_of_category(name: Column) -> Column:
    """Hex color of a category name; names outside the scale get the first color."""
    ladder = F.when(name == K.UNKNOWN_CATEGORY[0], F.lit(K.UNKNOWN_CATEGORY[1]))
    for entry in K.CATEGORIES:
        ladder = ladder.when(name == entry[1], F.lit(entry[2]))
    return ladder.otherwise(F.lit(K.CATEGORIES[0][2]))


def advisory_color(name: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, color in K.ADVISORY_COLORS.items():
        ladder = ladder.when(name == label, F.lit(color))
    return ladder.otherwise(F.lit("#ffbf00"))


def overlay_rgba(index: Column) -> Column:
    """Struct of r, g, b, a for a raster overlay; a missing value is transparent."""
    name = category(index, rounding=False)
    channels = []
    for position, channel in enumerate("rgba"):
        ladder = F.when(name.isNull(), F.lit(0))
        for label, rgba in K.OVERLAY_RGBA.items():
            ladder = ladder.when(name == label, F.lit(rgba[position]))
        channels.append(ladder.alias(channel))
    return F.struct(*channels)


def pm25_index(pm25: Column) -> Column:
    """PM2.5 index to one decimal (null when invalid)."""
    return F.bround(subindex(pm25, "pm25"), 1)


def pm25_category(pm25: Column) -> Column:
    """Category of the unrounded PM2.5 sub-index; "Unknown" when invalid."""
    return category(subindex(pm25, "pm25"))

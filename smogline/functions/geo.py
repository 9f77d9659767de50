"""Distances, grid cells and proximity cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smogline.constants import EARTH_RADIUS_KM, KM_PER_DEGREE


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.pow(F.sin(half_dlat), 2)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))


def flat_km(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column, at_lat: Column | None = None) -> Column:
    """Flat-earth distance; longitudes shrink with the cosine of ``at_lat`` (the query latitude)."""
    at_lat = lat if at_lat is None else at_lat
    dlat = (lat - ref_lat) * KM_PER_DEGREE
    dlon = (lon - ref_lon) * KM_PER_DEGREE * F.cos(F.radians(at_lat))
    return F.sqrt(dlat * dlat + dlon * dlon)


def flat_box_km(lat: Column, lon: Column, box: Column) -> Column:
    """Least :func:`flat_km` from a point to a box with fields south, north, west and east."""
    dlat = F.greatest(F.lit(0.0), box["south"] - lat, lat - box["north"]) * KM_PER_DEGREE
    dlon = F.greatest(F.lit(0.0), box["west"] - lon, lon - box["east"]) * KM_PER_DEGREE * F.cos(F.radians(lat))
    return F.sqrt(dlat * dlat + dlon * dlon)


def haversine_box_km(lat: Column, lon: Column, box: Column) -> Column:
    """No more than the least :func:`haversine_km` from a point to a box: the way to its latitudes, or to its nearer meridian around the globe."""
    dlat = F.radians(F.greatest(F.lit(0.0), box["south"] - lat, lat - box["north"]))
    inside = F.pmod(lon - box["west"], F.lit(360.0)) <= box["east"] - box["west"]
    dlon = F.when(inside, 0.0).otherwise(F.least(F.pmod(box["west"] - lon, F.lit(360.0)), F.pmod(lon - box["east"], F.lit(360.0))))
    meridian = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(dlon, F.lit(90.0)))))
    return EARTH_RADIUS_KM * F.greatest(dlat, meridian) * (1 - 1e-12)


#: The box distance that belongs to a distance.
BOX_DISTANCES = {flat_km: flat_box_km, haversine_km: haversine_box_km}


def cell(value: Column, decimals: int = 2) -> Column:
    """Grid bucket: the coordinate rounded half-even."""
    return F.bround(value, decimals)


def location_id(lat: Column, lon: Column, prefix: str = "cell") -> Column:
    """``prefix_LAT_LON`` of the 0.01 degree cell with the decimal points removed."""
    def text(value):
        return F.replace(cell(value).cast("string"), F.lit("."), F.lit(""))
    return F.concat_ws("_", F.lit(prefix), text(lat), text(lon))


class ProximityCells:
    """Cell keys such that two points within the radius always share a key once
    one side is replicated into its neighbourhood.

    Latitude is cut into bands at least one radius high.  Longitude is cut, per
    band, into cells wide enough for that band's latitude, counted around the
    globe so that the date line needs no special case.  The radius may be a
    column, for searches whose reach differs by row.
    """

    _COLUMNS = 100_000_000      # more cells than any band has

    def __init__(self, radius_km: float | Column):
        self.radius = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
        self.band_deg = self.radius / (KM_PER_DEGREE * 0.99)
        self.half_chord = F.sin(F.least(self.radius / (2 * EARTH_RADIUS_KM), F.lit(1.5)))

    def _cells_in(self, band: Column) -> Column:
        edge = F.greatest(F.abs(band), F.abs(band + 1)) * self.band_deg + self.band_deg
        shrink = F.cos(F.radians(F.least(edge, F.lit(89.9))))
        width = F.degrees(2 * F.asin(F.least(F.lit(1.0), self.half_chord / shrink))) * 1.01
        return F.greatest(F.floor(360.0 / width), F.lit(1))

    @staticmethod
    def _column(lon: Column, cells: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) * cells / 360.0), cells)

    def home(self, lat: Column, lon: Column) -> Column:
        band = F.floor(lat / self.band_deg)
        return band * self._COLUMNS + self._column(lon, self._cells_in(band))

    def spread(self, df: DataFrame, lat: str, lon: str, name: str = "_cell") -> DataFrame:
        """One row per distinct cell whose home points may lie within the radius."""
        steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b in (-1, 0, 1) for c in (0, 1, -1)])
        around = df.withColumn("_s", F.explode(steps)).withColumn("_band", F.floor(F.col(lat) / self.band_deg) + F.col("_s.b"))
        counted = around.withColumn("_cells", self._cells_in(F.col("_band")))
        # a band of one or two cells has no separate neighbours on both sides
        step = F.col("_s.c")
        distinct = counted.filter((step == 0) | ((step == 1) & (F.col("_cells") > 1)) | ((step == -1) & (F.col("_cells") > 2)))
        column = F.pmod(self._column(F.col(lon), F.col("_cells")) + step, F.col("_cells"))
        return distinct.withColumn(name, F.col("_band") * self._COLUMNS + column).drop("_s", "_band", "_cells")

"""Model features: encoding, transforms, interactions, scaling, matrices."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from smogline import constants as K
from smogline.operators.common import present, with_row_of
from smogline.operators.imputing import fit_medians
from smogline.session import materialise

CYCLES = {"hour": 24, "month": 12, "doy": 365}
MEDIAN_INPUTS = ["boundary_layer_height", "relative_humidity_2m", "temperature_2m"]


def time_parts(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.withColumns({"hour": F.hour(ts), "month": F.month(ts), "doy": F.dayofyear(ts)})


def cyclic_encode(df: DataFrame) -> DataFrame:
    """Hour, month and day of year as sine and cosine, wind direction as a unit vector."""
    new: dict[str, Column] = {}
    for c in present(df, CYCLES):
        angle = F.col(c) * (2 * pi / CYCLES[c])
        new |= {f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}
    dropped = present(df, CYCLES)
    if "wind_direction_10m" in df.columns:
        angle = F.radians(F.col("wind_direction_10m"))
        new |= {"wind_u": -F.sin(angle), "wind_v": -F.cos(angle)}
        dropped.append("wind_direction_10m")
    return df.withColumns(new).drop(*dropped)


def log_transform(df: DataFrame, columns=K.LOG_COLUMNS) -> DataFrame:
    """log1p of the heavy-tailed columns, negative values counted as 0."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0))))
                           for c in present(df, columns)})


def interaction_features(df: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """AOD/PBLH, wind x roads, humidity x PBLH and a heat-index proxy.

    Missing weather enters with its median: the fitted row if given, else the
    median of this table.
    """
    have = set(df.columns)
    needed = present(df, MEDIAN_INPUTS)
    out = with_row_of(df, medians if medians is not None else fit_medians(df, needed), "_m") if needed else df
    def filled(c):
        return F.coalesce(F.col(c), F.col("_m")[c])
    new: dict[str, Column] = {}
    if {"aod_550nm", "boundary_layer_height"} <= have:
        new["aod_pblh_ratio"] = (F.coalesce(F.col("aod_550nm"), F.lit(0.0))
                                 / F.nullif(F.coalesce(F.col("boundary_layer_height"), F.lit(1.0)), F.lit(0.0)))
    if {"wind_speed_10m", "road_density"} <= have:
        new["wind_road_exposure"] = F.coalesce("wind_speed_10m", F.lit(0.0)) * F.coalesce("road_density", F.lit(0.0))
    if {"relative_humidity_2m", "boundary_layer_height"} <= have:
        new["rh_pblh"] = filled("relative_humidity_2m") * filled("boundary_layer_height")
    if {"temperature_2m", "relative_humidity_2m"} <= have:
        t, rh = filled("temperature_2m"), filled("relative_humidity_2m")
        vapour = rh / 100 * 6.1078 * F.exp(17.27 * t / (t + 237.3))
        new["heat_index_proxy"] = t + 0.33 * vapour - 4.0
    return out.withColumns(new).drop("_m")


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean and sample deviation (0 counts as 1) of every column."""
    spread = {c: F.stddev_samp(c) for c in columns}
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns],
                  *[F.when(s == 0, 1.0).otherwise(s).alias(f"{c}_std") for c, s in spread.items()])


def standardise(df: DataFrame, columns: list[str], scaler: DataFrame | None = None) -> DataFrame:
    """z-scores with the fitted row, or with this table's own statistics."""
    row = scaler if scaler is not None else fit_scaler(df, columns)
    fitted = [c for c in columns if f"{c}_mean" in row.columns]
    return with_row_of(df, row).withColumns(
        {c: (F.col(c) - F.col(f"_stats.{c}_mean")) / F.col(f"_stats.{c}_std") for c in fitted}).drop("_stats")


def align(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the training columns in their order; a missing column is 0."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])


class FeatureSet:
    """Feature engineering with state fitted on the training rows.

    ``fit`` computes the medians and scaling statistics as one-row tables; both
    can be written and read like any table (``save`` / ``load``).
    """

    def __init__(self, group: str = "full", cyclic: bool = True, interactions: bool = True,
                 log: bool = True, scale: bool = False, keep: list[str] = ()):
        self.group, self.cyclic, self.interactions, self.log, self.scale = group, cyclic, interactions, log, scale
        self.keep = list(keep)
        self.names: list[str] = []
        self.medians: DataFrame | None = None
        self.scaler: DataFrame | None = None

    def columns(self, df: DataFrame) -> list[str]:
        """The columns of a table that the features are made from."""
        return [c for c in K.FEATURE_GROUPS[self.group] if c in df.columns and c not in self.keep]

    def _base(self, df: DataFrame) -> DataFrame:
        ts = next((c for c in ("timestamp_utc", "timestamp", "datetime", "date") if c in df.columns), None)
        if ts:
            df = time_parts(df, ts)
        wanted = [c for c in [*K.FEATURE_GROUPS[self.group], *CYCLES] if c in df.columns and c not in self.keep]
        out = df.select(*self.keep, *wanted)
        out = cyclic_encode(out) if self.cyclic else out.drop(*CYCLES)
        return log_transform(out) if self.log else out

    def _engineer(self, df: DataFrame) -> DataFrame:
        out = self._base(df)
        return interaction_features(out, self.medians) if self.interactions else out

    def fit(self, df: DataFrame, medians: DataFrame | None = None) -> "FeatureSet":
        """``medians``: a row fitted before on the same rows, of these inputs or more."""
        base = self._base(df)
        inputs = present(base, MEDIAN_INPUTS)
        if not (self.interactions and inputs):
            self.medians = None
        elif medians is not None:
            self.medians = medians.select(*inputs)
        else:
            # one row, read by every transform
            self.medians = materialise(fit_medians(base, inputs), "feature-medians")
        made = self._engineer(df)
        self.names = [c for c in made.columns if c not in self.keep]
        if self.scale:
            numeric = [f.name for f in made.schema.fields if isinstance(f.dataType, NumericType) and f.name in self.names]
            self.scaler = fit_scaler(made, numeric)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.names:
            raise RuntimeError("fit the feature set on training data first")
        made = self._engineer(df)
        if self.scaler is not None:
            made = standardise(made, present(made, self.names), self.scaler)
        return align(made, self.names, self.keep)

    def save(self, path: str) -> None:
        spark = self.medians.sparkSession if self.medians is not None else self.scaler.sparkSession
        options = [(self.group, self.cyclic, self.interactions, self.log, self.scale, self.keep, self.names)]
        spark.createDataFrame(options, "grp string, cyclic boolean, interactions boolean, log boolean, "
                              "scale boolean, keep array<string>, names array<string>"
                              ).write.mode("overwrite").parquet(f"{path}/options")
        for name in ("medians", "scaler"):
            table = getattr(self, name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureSet":
        o = spark.read.parquet(f"{path}/options").first()
        out = cls(o["grp"], o["cyclic"], o["interactions"], o["log"], o["scale"], list(o["keep"]))
        out.names = list(o["names"])
        if out.interactions:
            out.medians = spark.read.parquet(f"{path}/medians")
        if out.scale:
            out.scaler = spark.read.parquet(f"{path}/scaler")
        return out


def drop_leakage(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Drop index-derived columns; fail when the target is absent."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.drop(*present(df, K.FORBIDDEN_COLUMNS))


def feature_matrix(df: DataFrame, group: str = "full", target: str = K.TARGET, keep: list[str] = (),
                   extra: list[str] = ()) -> DataFrame:
    """Kept keys, engineered features of a group, extra columns as they are (lags), and the target."""
    clean = drop_leakage(df, target)
    kept = [*keep, *extra, target]
    return FeatureSet(group, keep=kept).fit(clean).transform(clean)

"""The training table: matched pixels with weather and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from smogline import constants as K
from smogline.functions import geo
from smogline.operators import cleaning, features, imputing, matching


def build_canonical(pixels: DataFrame, ground: DataFrame, weather: DataFrame, static: DataFrame, radius_km: float = 25.0,
                    window_minutes: float = 60.0, static_order: list[str] = ("location_id",), record_id: str = "record_id",
                    prefix: str = "cell", target_source: str = "pm25", training: bool = True) -> DataFrame:
    """Collocate, join weather and static cells, guard against leakage, impute, deduplicate.

    The satellite's position and time are the row's; the ground time is kept apart.
    """
    pairs = matching.collocate(pixels, ground, [target_source], radius_km, window_minutes, record_id, (target_source,))
    named = cleaning.alias_harmonise(pairs, cleaning.CANONICAL_ALIASES)
    flagged = cleaning.short_gas_flags(named)
    with_weather = matching.weather_cell_join(flagged, weather)
    with_static = matching.static_cell_join(with_weather, static, list(static_order))
    for name in [*K.WEATHER_COLUMNS, *K.STATIC_COLUMNS]:
        if name not in with_static.columns:
            with_static = with_static.withColumn(name, F.lit(None).cast("string" if name == "land_use_class" else "double"))
    if "location_id" not in with_static.columns:
        with_static = with_static.withColumn("location_id", geo.location_id(F.col("latitude"), F.col("longitude"), prefix))
    guarded = features.drop_leakage(with_static)
    imputed = imputing.impute_policy(guarded, training=training, targets=(K.TARGET,))
    return imputed.withColumn("satellite_timestamp", F.col("timestamp_utc")).dropDuplicates()

"""Ordered operations per time series that stay balanced when one series is huge.

A plain ``Window.partitionBy(station)`` puts a whole station into one task.  Here
every series is cut into time slices first; what a slice needs from its
neighbours travels through a small per-slice table.  Results equal the plain
window's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline import constants as K
from smogline.functions import clock
from smogline.operators.common import with_row_of
from smogline.operators.quantiles import exact_quantiles

SLICE_SECONDS = 3600
ROWS_PER_BLOCK = 200_000
ROWS_PER_SLICE = 1_000_000      # a slice with more rows is cut into pieces
SAMPLED = 8                     # sampled keys for each cut


def _sliced(df: DataFrame, keys: list[str], ts: str, slice_seconds: int, tie: list[str] | tuple = (), most: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds ``_part``: series keys, time slice and piece of the slice as one value.

    As one struct it is never null itself, so rows without a key join like any
    other, and window, aggregate and join all reuse the same partitioning.

    A slice of more than ``most`` rows, which may be one time stamp or all rows without a time, is cut into pieces along the order of (time, tie): the cuts are
    keys of a sample of its rows, one for about ``most`` rows.  The tables of such slices and of their cuts hold at most one
    row for every ``most`` rows of the input, so they are broadcast.
    """
    part = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [clock.time_chunk(F.col(ts), slice_seconds).alias("_slice")]
    coarse = df.withColumn("_part", F.struct(*part))
    large = coarse.groupBy(F.col("_part").alias("_large")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_large")
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(dict.fromkeys([ts, *tie]))])
    every, hashed = max(1, most // SAMPLED), [c for c, kind in df.dtypes if "map<" not in kind]
    sample = (coarse.join(F.broadcast(large), F.col("_part") == F.col("_large"))
              .filter(F.pmod(F.xxhash64(*hashed), F.lit(every)) == 0).select("_large", key.alias("_key")))
    cuts = sample.groupBy("_large").agg(F.filter(F.sort_array(F.collect_set("_key")), lambda c, i: i % SAMPLED == SAMPLED - 1).alias("_cuts"))
    met = coarse.withColumn("_key", key).join(F.broadcast(cuts), F.col("_part") == F.col("_large"), "left")
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_key"))), F.lit(0))
    return met.withColumn("_part", F.struct("_part.*", piece.alias("_piece"))).drop("_large", "_key", "_cuts")


def _over_slices(keys: list[str], backwards: bool = False):
    """Window over the slices of a series (a table of slices, not of rows)."""
    series = [F.col(f"_part.k{i}") for i in range(len(keys))]
    places = [F.col("_part._slice"), F.col("_part._piece")]
    return (Window.partitionBy(*series) if series else Window).orderBy(*[p.desc() for p in places] if backwards else places)


def rank(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None,
         slice_seconds: int = SLICE_SECONDS, name: str = "series_row", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number the rows of each series 1, 2, 3 … in time order.

    Slices are numbered on their own and shifted by the size of the slices
    before them, so no task holds more than one slice.
    """
    sliced = _sliced(df, keys, ts, slice_seconds, tie or [], rows_per_slice)
    earlier = _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sliced.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
             .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(ts, *(tie or [])))
    return (sliced.withColumn("_inner", inner).join(sizes, "_part")
            .withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_before", "_inner"))


def windowed(df: DataFrame, keys: list[str], ts: str, tie: list[str], before: int, after: int,
             columns: Callable[[Window], dict[str, Column]], rows_per_block: int = ROWS_PER_BLOCK,
             slice_seconds: int = SLICE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Rows are ranked, grouped into blocks of ``rows_per_block`` and the few rows at
    a block's ends are copied to its neighbours, which makes every block complete.
    """
    if max(before, after) > rows_per_block:
        raise ValueError("a block must be at least as long as the look-around")
    position = F.col("series_row") - 1
    block = F.floor(position / rows_per_block)
    place = position % rows_per_block
    homes = F.array_compact(F.array(
        block,
        F.when(place >= rows_per_block - before, block + 1) if before else F.lit(None).cast("long"),
        F.when((place < after) & (block > 0), block - 1) if after else F.lit(None).cast("long"),
    ))
    copies = rank(df, keys, ts, tie, slice_seconds, rows_per_slice=rows_per_slice).withColumn("_own", block).withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*keys, "_block").orderBy("series_row")
    return copies.withColumns(columns(window)).filter(F.col("_block") == F.col("_own")).drop("_own", "_block", "series_row")


def carry(df: DataFrame, keys: list[str], ts: str, tie: list[str], fills: dict[str, tuple[str, str]],
          slice_seconds: int = SLICE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Bring the nearest non-null value of a column to each row.

    ``fills`` maps an output name to ``(source column, direction)``; direction
    "last" looks at this row and earlier ones, "next" at this row and later ones.
    """
    order = [F.col(ts), *[F.col(t) for t in tie]]
    sliced = _sliced(df, keys, ts, slice_seconds, tie, rows_per_slice)
    # looking ahead is looking back in the reversed order: a frame that starts at the partition's first row grows
    # by one row at a time, one that ends at its last row is read anew for every row
    windows = {"last": Window.partitionBy("_part").orderBy(*order), "next": Window.partitionBy("_part").orderBy(*[o.desc() for o in order])}

    edges, carried, local = [], [], {}
    for i, (source, direction) in enumerate(fills.values()):
        seen = F.when(F.col(source).isNotNull(), F.struct(*order, F.col(source).alias("v")))
        edges.append((F.max if direction == "last" else F.min)(seen).alias(f"_e{i}"))
        earlier = _over_slices(keys, direction == "next").rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"_e{i}", ignorenulls=True).over(earlier)["v"].alias(f"_c{i}"))
        local[f"_l{i}"] = F.last(source, ignorenulls=True).over(windows[direction].rowsBetween(Window.unboundedPreceding, 0))
    summary = sliced.groupBy("_part").agg(*edges).select("_part", *carried)
    joined = sliced.withColumns(local).join(summary, "_part")
    out = joined.withColumns({name: F.coalesce(F.col(f"_l{i}"), F.col(f"_c{i}")) for i, name in enumerate(fills)})
    helpers = [f"_{p}{i}" for i in range(len(fills)) for p in "lc"]
    return out.drop("_part", *helpers)


def _same_as_previous(value: str, steps: int, window) -> Column:
    """True when the value equals each of its ``steps`` predecessors."""
    same = F.lit(True)
    for k in range(1, steps + 1):
        same = same & F.coalesce(F.col(value) == F.lag(value, k).over(window), F.lit(False))
    return same


def flatline_mask(df: DataFrame, values: list[str], keys=("station_id",), ts="timestamp_utc",
                  tie=(), run: int = 4, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blank the ``run``-th and later of consecutive identical readings of a station.

    Being in a run of at least ``run`` only depends on the ``run - 1`` rows before.
    """
    flags = windowed(df, list(keys), ts, list(tie), run - 1, 0,
                     lambda w: {f"_flat_{v}": _same_as_previous(v, run - 1, w) for v in values}, rows_per_block)
    masked = {v: F.when(~F.col(f"_flat_{v}"), F.col(v)) for v in values}
    return flags.withColumns(masked).drop(*[f"_flat_{v}" for v in values])


def stuck_drop(df: DataFrame, value: str, keys=("station_id",), ts="timestamp_utc", tie=(),
               repeats: int = 5, limits=(0.0, 1000.0), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Keep readings within limits, then drop a row equal to all ``repeats`` predecessors."""
    valid = df.filter(F.col(value).between(*limits))
    flagged = windowed(valid, list(keys), ts, list(tie), repeats, 0,
                       lambda w: {"_stuck": _same_as_previous(value, repeats, w)}, rows_per_block)
    return flagged.filter(~F.col("_stuck")).drop("_stuck")


def lag_columns(target: str = K.TARGET, lags=K.LAG_HOURS) -> list[str]:
    return [f"{target}_lag_{k}h" for k in lags]


def lag_lead_features(df: DataFrame, target: str = K.TARGET, keys=("station_id",), ts="timestamp_utc", tie=(),
                      lags=K.LAG_HOURS, horizons=K.HORIZON_HOURS, rolling: bool = False, extremes: bool = False,
                      rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Row lags and leads per station, optionally with rolling statistics.

    Rolling columns: mean of 6 and 24 rows, sample deviation of 24 rows (0 when
    undefined); ``extremes`` adds the 24-row maximum and minimum.
    """
    def build(w):
        made = {f"{target}_lag_{k}h": F.lag(target, k).over(w) for k in lags}
        if rolling:
            six, day = w.rowsBetween(-5, 0), w.rowsBetween(-23, 0)
            made[f"{target}_rolling_mean_6h"] = F.avg(target).over(six)
            made[f"{target}_rolling_mean_24h"] = F.avg(target).over(day)
            made[f"{target}_rolling_std_24h"] = F.coalesce(F.stddev_samp(target).over(day), F.lit(0.0))
            if extremes:
                made[f"{target}_rolling_max_24h"] = F.max(target).over(day)
                made[f"{target}_rolling_min_24h"] = F.min(target).over(day)
        made.update({f"target_lead_{h}h": F.lead(target, h).over(w) for h in horizons})
        return made

    back = max([*lags, 23 if rolling else 0], default=0)
    ahead = max(horizons, default=0)
    return windowed(df, list(keys), ts, list(tie), back, ahead, build, rows_per_block)


def lag_lead_exact(df: DataFrame, target: str = K.TARGET, keys=("station_id",), ts="timestamp_utc",
                   lags=K.LAG_HOURS, horizons=K.HORIZON_HOURS) -> DataFrame:
    """Lags and leads by clock time: every reading is sent to the times that want it, once for all shifts.

    Needs one row per (keys, timestamp).
    """
    shifts = {f"{target}_lag_{k}h": k for k in lags} | {f"target_lead_{h}h": -h for h in horizons}
    sent = F.array(*[F.struct((F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).alias("at"), F.lit(i).alias("i")) for i, hours in enumerate(shifts.values())])
    moved = df.select(*keys, F.col(target).alias("_v"), F.inline(sent)).groupBy(*keys, F.col("at").alias(ts)).agg(
        *[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(name) for i, name in enumerate(shifts)])
    return df.join(moved, [*keys, ts], "left")


def lag_impute(df: DataFrame, target: str = K.TARGET, keys=("station_id",), ts="timestamp_utc", tie=(),
               lags=K.LAG_HOURS, first_lead: str | None = None) -> DataFrame:
    """Fill missing lags from the station's next known one, then with the global
    median of the target; rows without the first lead are dropped."""
    names = lag_columns(target, lags)
    filled = carry(df, list(keys), ts, list(tie), {f"_f_{n}": (n, "next") for n in names})
    with_median = with_row_of(filled, exact_quantiles(df, [], [target], [0.5]), "_m")
    lead = first_lead or f"target_lead_{K.HORIZON_HOURS[0]}h"
    return (with_median
            .withColumns({n: F.coalesce(F.col(f"_f_{n}"), F.col("_m")[f"{target}_p50"]) for n in names})
            .filter(F.col(lead).isNotNull())
            .drop("_m", *[f"_f_{n}" for n in names]))


def gap_interpolate(df: DataFrame, value: str, keys=("station_id",), ts="timestamp_utc", tie=(),
                    max_gap_hours: float = 3.0) -> DataFrame:
    """Fill missing values linearly in time where the known neighbours are at most
    ``max_gap_hours`` apart."""
    known = df.withColumn("_known", F.when(F.col(value).isNotNull(), F.struct(
        clock.seconds(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"))))
    near = carry(known, list(keys), ts, list(tie), {"_prev": ("_known", "last"), "_next": ("_known", "next")})
    gap = F.col("_next.t") - F.col("_prev.t")
    share = (clock.seconds(F.col(ts)) - F.col("_prev.t")) / F.nullif(gap, F.lit(0.0))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    return near.withColumn(value, F.coalesce(F.col(value), F.when(gap <= max_gap_hours * 3600, line))
                           ).drop("_known", "_prev", "_next")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              values: list[str], right_tie: list[str], left_id: list[str]) -> DataFrame:
    """Latest right row at or before each left row (backward as-of join).

    The two sides are stacked and the last right row is carried forward; nothing
    is paired, so a key with many rows on both sides costs no more than its rows.
    Of right rows with equal time the first by ``right_tie`` counts.
    """
    keyed = right.na.drop(subset=[*keys, right_ts])       # a missing key matches nothing
    latest = keyed.groupBy(*keys, F.col(right_ts).alias("_t")).agg(
        F.min_by(F.struct(*[F.col(v) for v in values], F.col(right_ts).alias("_seen")),
                 F.struct(*right_tie)).alias("_row"))
    stacked = left.withColumns({"_t": F.col(left_ts), "_kind": F.lit(1)}).unionByName(
        latest.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    carried = carry(stacked, keys, "_t", ["_kind", *left_id], {"_hit": ("_row", "last")})
    return (carried.filter(F.col("_kind") == 1)
            .withColumns({v: F.col("_hit")[v] for v in values} | {"matched_ts": F.col("_hit")["_seen"]})
            .drop("_t", "_kind", "_row", "_hit"))

"""Exact interpolated quantiles in two scans, without gathering a group in one task.

The first scan makes a Greenwald-Khanna sketch of every group, which merges on the map side.  Its error is proven, so it names for each
wanted rank a bracket of values that certainly holds it, about a hundredth of the group wide.  The second scan counts what lies below the bracket,
keeps the values inside, adds up equal ones and puts only those in order.  A group of a few values has a bracket that holds
them all; nothing depends on how large a group is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline.operators.common import count_if, unpivot, with_row_of

Position = Callable[[Column], Column]

# The sketch's accuracy: a rank is wrong by at most 1/ACCURACY of the group's size.
ACCURACY = 1000
# Sketched shares of a group where the wanted positions are not known beforehand.
SHARES = tuple(i / 128 for i in range(129))


def around(probs: list[float], accuracy: int = ACCURACY) -> tuple[float, ...]:
    """Shares to sketch for known probabilities: four errors to either side of each, wide enough for any group of ``accuracy`` values or more."""
    return tuple(sorted({g for p in probs for g in (p - 4 / accuracy, p + 4 / accuracy) if 0 <= g <= 1})) or (0.5,)


def column_name(column: str, prob: float) -> str:
    return f"{column}_p{format(prob * 100, 'g').replace('.', '_')}"


def interpolated(prob: float) -> Position:
    """Linear interpolation between the two values around the wanted share."""
    return lambda n: F.lit(float(prob)) * (n - 1)


def _bracket(at: Column, size: Column, sketch: Column, shares: tuple[float, ...], accuracy: int) -> dict[str, Column]:
    """The two ranks that a position wants, the share of the upper one and the ends of a bracket that holds both.

    Twice the sketch's error is left on either side; where no sketched share is far enough out, as in a small group, the bracket is open.
    """
    n, margin, grid = F.nullif(size, F.lit(0)), 2.0 / accuracy, F.array(*map(F.lit, shares))
    low, high = F.floor(at), F.ceil(at)
    below = F.size(F.filter(grid, lambda g: g <= low / n - margin)) - 1
    above = F.size(F.filter(grid, lambda g: g < (high + 1) / n + margin))
    return {"low": low.cast("long"), "high": high.cast("long"), "share": (at - low).cast("double"),
            "from": F.when(below >= 0, F.get(sketch, below)).otherwise(float("-inf")), "to": F.coalesce(F.get(sketch, above), F.lit(float("inf")))}


def _brackets(sketches: DataFrame, positions: list[Position], shares: tuple[float, ...], accuracy: int) -> DataFrame:
    """(_g, _n, _b): the bracket of each position."""
    def bracket(i: int, at: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), *[c.alias(name) for name, c in _bracket(at, F.col("_n"), F.col("_s"), shares, accuracy).items()])
    return sketches.select("_g", "_n", F.array(*[bracket(i, p(F.col("_n"))) for i, p in enumerate(positions)]).alias("_b"))


def long_quantiles(long: DataFrame, by: list[str], value: str, positions: list[Position], shares: tuple[float, ...] = SHARES, accuracy: int = ACCURACY) -> DataFrame:
    """``by`` columns plus an array ``q`` of the values at the zero-based positions (each a
    function of the group's size) and ``n``, the number of values.

    One row for every group of the input, null keys included; a group without values has null
    quantiles and n = 0.  Without ``by`` there is always one row.
    """
    # a struct is never null itself, so groups with null keys join and window like others
    group = F.struct(*[F.col(b).alias(f"g{i}") for i, b in enumerate(by)], F.lit(0).alias("one"))
    number = F.col(value).cast("double")
    # + 0.0 folds the two zeros into one
    rows = long.select(group.alias("_g"), F.when(~F.isnan(number), number + F.lit(0.0)).alias("_v"))
    grid = F.array(*map(F.lit, shares))
    summary = [F.count("_v").alias("_n"), F.percentile_approx("_v", grid, accuracy).alias("_s")]
    sketches = rows.groupBy("_g").agg(*summary) if by else rows.agg(*summary).select(F.struct(F.lit(0).alias("one")).alias("_g"), "_n", "_s")
    brackets = _brackets(sketches, positions, shares, accuracy)
    known = rows.filter(F.col("_v").isNotNull())
    met = known.join(brackets, "_g") if by else known.join(F.broadcast(brackets.drop("_g")))      # one row without groups
    seen = F.transform("_b", lambda b: F.struct(b["i"].alias("i"), b["low"].alias("low"), b["high"].alias("high"), b["share"].alias("share"), b["to"].alias("to"),
                                                F.when(F.col("_v") >= b["from"], F.col("_v")).alias("v")))
    # null stands for all values below the bracket; those above it are left
    kept = met.select("_g", "_n", F.explode(F.filter(seen, lambda b: b["v"].isNull() | (b["v"] <= b["to"]))).alias("_w"))
    counts = kept.groupBy("_g", "_w.i", "_w.v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), *[F.first(f"_w.{x}").alias(x) for x in ("low", "high", "share")])
    order = Window.partitionBy("_g", "i").orderBy(F.col("v").asc_nulls_first())
    before = F.sum("_c").over(order) - F.col("_c")
    placed = counts.withColumn("_before", before)
    holds = lambda rank: F.col("v").isNotNull() & (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_c"))
    picked = placed.filter(holds("low") | holds("high")).groupBy("_g", "i").agg(
        F.max(F.when(holds("low"), F.col("v"))).alias("a"), F.max(F.when(holds("high"), F.col("v"))).alias("z"), F.first("share").alias("share"), F.first("_n").alias("_n"))
    found = picked.select("_g", "i", "_n", (F.col("a") * (1.0 - F.col("share")) + F.col("z") * F.col("share")).alias("v"))
    # every group takes part, also one without a value
    every = found.unionByName(brackets.select("_g", F.lit(None).cast("int").alias("i"), "_n", F.lit(None).cast("double").alias("v")))
    size = F.max("_n")
    def answer(i: int, at: Column) -> Column:
        value = F.max(F.when(F.col("i") == i, F.col("v")))
        # the sketch's error is proven; should it ever be larger, fail rather than answer wrongly
        lost = value.isNull() & (size > 0) & (F.floor(at) >= 0) & (F.ceil(at) < size)
        return F.when(lost, F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")).otherwise(value)
    out = [F.array(*[answer(i, p(size)) for i, p in enumerate(positions)]).alias("q"), size.cast("long").alias("n")]
    return every.groupBy("_g").agg(*out).select(*[F.col(f"_g.g{i}").alias(b) for i, b in enumerate(by)], "q", "n")


def _whole_table(df: DataFrame, columns: list[str], probs: list[float], accuracy: int, shares: tuple[float, ...]) -> DataFrame:
    """One row of quantiles of whole columns.

    All columns are sketched and counted side by side in scans of the table as it stands; only values inside a bracket become rows of their
    own and are shuffled, about a hundredth of all.
    """
    number = [F.col(c).cast("double") for c in columns]
    # + 0.0 folds the two zeros into one
    values = df.select(*[F.when(~F.isnan(x), x + F.lit(0.0)).alias(f"v{i}") for i, x in enumerate(number)])
    wanted = [(i, p) for i in range(len(columns)) for p in probs]
    summary = values.agg(*[a for i in range(len(columns)) for a in
                           (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", F.array(*map(F.lit, shares)), accuracy).alias(f"s{i}"))])
    brackets = [_bracket(interpolated(p)(F.col(f"n{i}")), F.col(f"n{i}"), F.col(f"s{i}"), shares, accuracy) for i, p in wanted]
    edges = summary.select(F.array(*[F.struct(F.col(f"n{i}").alias("n"), *[c.alias(name) for name, c in b.items()]) for (i, _), b in zip(wanted, brackets)]).alias("of"))
    met = with_row_of(values, edges, "_e")
    sides = [(F.col(f"v{i}"), F.col("_e.of")[k]["from"], F.col("_e.of")[k]["to"]) for k, (i, _) in enumerate(wanted)]
    inside = F.array(*[F.when((v >= low) & (v <= high), v) for v, low, high in sides])
    below = met.agg(F.array(*[count_if(v < low) for v, low, _ in sides]).alias("n"))
    counts = met.select(F.posexplode(inside).alias("k", "v")).filter(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("_c"))
    placed = with_row_of(with_row_of(counts, edges, "_e"), below, "_below")
    bracket = F.col("_e.of")[F.col("k")]
    before = F.col("_below.n")[F.col("k")] + F.sum("_c").over(Window.partitionBy("k").orderBy("v")) - F.col("_c")
    ranked = placed.withColumn("_b", bracket).withColumn("_before", before)
    holds = lambda rank: (F.col("_b")[rank] >= F.col("_before")) & (F.col("_b")[rank] < F.col("_before") + F.col("_c"))
    picked = ranked.filter(holds("low") | holds("high")).groupBy("k").agg(
        F.max(F.when(holds("low"), F.col("v"))).alias("a"), F.max(F.when(holds("high"), F.col("v"))).alias("z"), F.first("_b.share").alias("share"))
    value = F.col("a") * (1.0 - F.col("share")) + F.col("z") * F.col("share")
    row = with_row_of(picked.agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"q{k}") for k in range(len(wanted))]), edges, "_e")
    def answer(k: int) -> Column:
        # the sketch's error is proven; should it ever be larger, fail rather than answer wrongly
        lost = F.col(f"q{k}").isNull() & (F.col("_e.of")[k]["n"] > 0)
        return F.when(lost, F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")).otherwise(F.col(f"q{k}"))
    return row.select(*[answer(k).alias(column_name(columns[i], p)) for k, (i, p) in enumerate(wanted)])


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], probs: list[float], accuracy: int = ACCURACY, shares: tuple[float, ...] | None = None) -> DataFrame:
    """One row per group with a column ``<column>_p<percent>`` per column and probability.

    A group (null keys included) without a value gets nulls.  With no ``by`` there is always one row.
    """
    shares = shares or around(probs, accuracy)
    if not by and columns:
        return _whole_table(df, list(columns), list(probs), accuracy, shares)
    long = unpivot(df.select(*by, *columns), by, columns, "_name", "_value")
    found = long_quantiles(long, [*by, "_name"], "_value", [interpolated(p) for p in probs], shares, accuracy)
    wide = [F.max(F.when(F.col("_name") == c, F.col("q")[i])).alias(column_name(c, p)) for c in columns for i, p in enumerate(probs)]
    return found.groupBy(*by).agg(*wide)

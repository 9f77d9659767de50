"""The k-th row of a table in an order, found by counting: no task ranks or holds more than a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smogline.functions import clock
from smogline.session import materialise

RANGES = 1 << 16        # counted ranges of a round over numbers
PIVOTS = 63             # keys that part the rows of a round over other orders
FEW = 10_000            # rows that are put in order at once


def kth_number(df: DataFrame, value: Column, k: int) -> tuple[int, int] | None:
    """The k-th smallest (from 1) of a long column without nulls and the number of smaller ones.

    Each round counts the values in equal ranges of what is left and goes on with the range that holds the k-th, which
    shrinks 65,536-fold: four rounds reach one value from all longs.
    """
    rows = df.select(value.cast("long").alias("v"))
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("z")).first()
    low, high, before = ends["a"], ends["z"], 0
    if low is None:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // RANGES))
        at = F.floor((F.col("v").cast("decimal(20,0)") - low) / width) if high - low >= 2**62 else F.expr(f"(v - {low}L) div {width}L")
        counts = rows.filter(F.col("v").between(low, high)).groupBy(at.cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n")).orderBy("r").collect()
        for r in counts:
            if before + r["n"] >= k:
                low, high = low + r["r"] * width, min(high, low + (r["r"] + 1) * width - 1)
                break
            before += r["n"]
        else:
            return None
    return low, before


def kth_key(df: DataFrame, key: list[str], k: int, few: int = FEW) -> tuple[tuple, int] | None:
    """The values of the k-th row (from 1) in the order of the key columns (nulls first) and the number of rows with smaller keys.

    Each round draws pivots, counts the rows between and at them and goes on between two of them; a key that many rows share
    becomes a pivot and ends the search.
    """
    rows = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).alias("k"))
    before, left = 0, rows.count()
    if not 1 <= k <= left:
        return None
    while left > few:
        drawn = rows.orderBy(F.xxhash64("k", F.monotonically_increasing_id())).limit(PIVOTS).distinct()
        pivots = drawn.agg(F.sort_array(F.collect_list("k")).alias("p"))
        # 2i: between pivots i - 1 and i, 2i + 1: at pivot i
        placed = rows.withColumn("p", pivots.scalar()).withColumn("at", 2 * F.size(F.filter("p", lambda p: p < F.col("k"))) + F.array_contains("p", F.col("k")).cast("int"))
        counts = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("z")).orderBy("at").collect()
        for r in counts:
            if before + r["n"] >= k:
                break
            before += r["n"]
        if r["at"] % 2:
            return tuple(r["a"]), before
        ends = rows.sparkSession.createDataFrame([(r["a"], r["z"])], rows.select(F.col("k").alias("a"), F.col("k").alias("z")).schema)
        rows = rows.withColumn("e", ends.select(F.struct("a", "z").alias("e")).scalar()).filter((F.col("k") >= F.col("e.a")) & (F.col("k") <= F.col("e.z"))).select("k")
        left = r["n"]
    ordered = [tuple(r["k"]) for r in rows.orderBy("k").limit(k - before).collect()]
    last = ordered[-1]
    return last, before + sum(o != last for o in ordered)


def _alone(df: DataFrame, key: list[str], values: tuple) -> bool:
    """Whether one row has these values of the key columns."""
    literal = df.sparkSession.createDataFrame([values], df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).schema)
    mine = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    return df.withColumn("_cut", literal.select(F.struct("*").alias("s")).scalar()).filter(mine == F.col("_cut")).limit(2).count() == 1


def mark_first(df: DataFrame, ts: str, tie: list[str], k: int, name: str) -> DataFrame:
    """Adds the boolean ``name``: whether a row is among the first k by time (rows without one last), then by the tie columns, then by all columns.

    Of rows equal in every column as many are marked as k leaves, told apart by their place in a written copy.
    """
    if k <= 0:
        return df.withColumn(name, F.lit(False))
    at = clock.micros(F.col(ts))
    known = df.filter(F.col(ts).isNotNull())
    cut = kth_number(known, at, k)
    if cut is not None:
        same, before, earlier = at == cut[0], cut[1], F.coalesce(at < cut[0], F.lit(False))
    else:
        same, before, earlier = F.col(ts).isNull(), known.count(), F.col(ts).isNotNull()
    inside = df.filter(same)
    order = list(dict.fromkeys(tie))
    found = kth_key(inside, order, k - before) if order else None
    if found is None or not _alone(inside, order, found[0]):
        # the tie columns do not tell the cut's row from others
        order += [c for c in df.columns if c not in tie and c != ts]
        found = kth_key(inside, order, k - before)
    if found is None:       # fewer rows than k
        return df.withColumn(name, F.lit(True))
    key, smaller = found
    mine = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    literal = df.sparkSession.createDataFrame([key], inside.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).schema)
    marked = df.withColumn("_cut", literal.select(F.struct("*").alias("s")).scalar()).withColumn("_same", F.coalesce(same, F.lit(False)))
    first = earlier | (F.col("_same") & (mine < F.col("_cut")))
    last = F.col("_same") & (mine == F.col("_cut"))
    equal, take = marked.filter(last), k - before - smaller
    if equal.count() == take:
        return marked.withColumn(name, first | last).drop("_cut", "_same")
    equal = materialise(equal.drop("_cut", "_same").withColumn("_place", F.monotonically_increasing_id()), "equal-rows")
    place = kth_number(equal, F.col("_place"), take)
    return marked.filter(~last).withColumn(name, first).drop("_cut", "_same").unionByName(equal.withColumn(name, F.col("_place") <= place[0]).drop("_place"))

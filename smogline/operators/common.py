"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_row_of(df: DataFrame, one_row: DataFrame, name: str = "_stats", now: bool = False) -> DataFrame:
    """Attach a one-row DataFrame as a struct column (a scalar subquery, no join).

    ``now`` computes the row at once and attaches literals: for small statistics
    that several branches of a plan refer to, each of which would otherwise carry
    its own copy of the subquery.
    """
    if now:
        row = one_row.first()
        values = [F.lit(row[f.name] if row else None).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
        return df.withColumn(name, F.struct(*values))
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s"))
    return df.withColumn(name, packed.scalar())


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long; all value columns become doubles."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias(value)) for v in values])
    return df.select(*ids, F.inline(pairs))


def count_if(condition: Column) -> Column:
    """Number of rows for which the condition is true."""
    return F.count(F.when(condition, F.lit(1)))

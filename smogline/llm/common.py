"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from smogline.session import work_folder

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, noted in the surrounding :func:`scratch` block if there is one."""
    path = work_folder(spark, label)
    if (noted := _scratch.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def scratch():
    """Collects the paths of the intermediate tables made inside; hand them to :func:`remove` once the result is written."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no pending DataFrame reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and a
    table read several times is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_sorting(df: DataFrame) -> DataFrame:
    """The table, to be joined by sorting and never as a whole in every task.

    Spark judges a table by its files, however many rows an explode or a Python function makes of each of theirs and however well they are
    packed: what looks like a few megabytes is collected by the driver and may be a hundred times that.
    """
    return df.hint("merge")


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def total(numbers: Column) -> Column:
    """Sum of an array of longs; 0 when empty."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


class Remembered:
    """A bounded dictionary of results that can be worked out again: two generations of at most ``limit`` entries each.

    When the young one is full it becomes the old one, and what is asked for again moves back.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self._old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those of the keys whose results are not known; the others are in ``young`` afterwards."""
        if len(self.young) > self.limit:
            self._old, self.young = self.young, {}
        return self.unknown(keys)

    def unknown(self, keys: set) -> set:
        """Like :meth:`missing`, but nothing grows old: what an earlier call found stays."""
        keys = keys.difference(self.young)
        for key in keys.intersection(self._old):
            self.young[key] = self._old[key]
        return keys.difference(self.young)


def per_process(key: tuple, make: Callable):
    """One object per Python worker and key, kept from task to task where Spark reuses its workers.

    A worker that is asked for another key lets the earlier one go: its stage is over.
    """
    kept = _kept()
    if key not in kept:
        release()
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Lets go of what :func:`per_process` keeps in this Python worker."""
    kept = _kept()
    for old in [k for k in kept if isinstance(k, tuple)]:
        del kept[old]


def _kept() -> dict:
    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__

"""Registered queries: a Spark builder and, where SQL can say it, the checking text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline.plans.views import Tables, with_views
from smogline.session import tune

SCALE = 1e6         # compared doubles are rounded to six decimals
# Added before rounding so that means which end in an exact 5 do not sit on the edge
# between two roundings, where the last bit of a sum would decide.
NUDGE = 1.2345e-7


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        out = self.build(Tables(tune(spark), folder))
        # floating sums depend on the order of addition in their last bits
        return out.withColumns({c: F.floor((F.col(c) + NUDGE) * SCALE + 0.5) / SCALE for c in self.doubles}) if self.doubles else out

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        rounded = ", ".join(f"floor((CAST({c} AS DOUBLE) + {NUDGE}::DOUBLE) * {SCALE}::DOUBLE + 0.5::DOUBLE) / {SCALE}::DOUBLE AS {c}" for c in self.doubles)
        body = f"SELECT * REPLACE ({rounded}) FROM ({self.sql})" if rounded else self.sql
        return with_views(body)


QUERIES: dict[str, Query] = {}


def query(name: str, doubles: str = "", sql: str | None = None):
    """Register a builder that takes the tables of a data folder."""
    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql, tuple(doubles.split()))
        return build
    return add

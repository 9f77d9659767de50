"""Ranks and running totals inside groups of any size: rows are sorted in range partitions, so a group may span many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import staged


def _accumulated(groups: int, sums: int, xors: int):
    def run(batches):
        part, last, carry, held = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:groups + sums + xors]]
            keys, values = columns[:groups], [np.ones(batch.num_rows, dtype=np.int64), *columns[groups:]]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(int(k[0]) for k in keys)
            new[0] = first != last
            starts = np.flatnonzero(new)
            # where the current run of equal groups starts; -1 stands for a run that began in an earlier batch
            at = np.full(batch.num_rows, -1)
            at[starts] = starts
            at = np.maximum.accumulate(at)
            out = []
            for i, v in enumerate(values):
                fold = np.bitwise_xor if i > sums else np.add
                acc = fold.accumulate(v)
                before = np.where(at > 0, acc[at - 1], 0)
                acc = (acc ^ before) if i > sums else acc - before
                if carry is not None:
                    acc = np.where(at < 0, fold(acc, carry[i]), acc)
                out.append(acc)
            last, carry = tuple(int(k[-1]) for k in keys), [int(v[-1]) for v in out]
            arrays = [*batch.columns, *[pa.array(v, pa.int64()) for v in out], pa.array(np.full(batch.num_rows, part), pa.int64())]
            if held is not None:
                yield held(False)
            held = lambda tail, a=arrays: pa.RecordBatch.from_arrays([*a, pa.array(np.arange(len(a[0])) == (len(a[0]) - 1 if tail else -1))], names=names)
            names = [*batch.schema.names, "_n", *[f"_acc{i}" for i in range(sums + xors)], "_part", "_tail"]
        if held is not None:
            yield held(True)
    return run


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """``rows`` with its rank in its group (from 1) and running totals: ``sums`` and ``xors`` map a new column to the column it adds up.

    Group columns and totalled columns are longs without nulls; ``order`` sorts the rows of a group and rows it leaves equal
    must be alike.  Rows are dealt by ranges of (group, order), so each task holds one batch of rows and a group with
    a third of all rows spreads over a third of the tasks.  A group that starts in one range and goes on in the next takes
    its totals along: one row a range comes to the driver.
    """
    sums, xors = sums or {}, xors or {}
    taken = [*group, *sums.values(), *xors.values()]
    flat = rows.select(*[F.col(c).alias(f"_in{i}") for i, c in enumerate(taken)], *[c.alias(f"_by{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("_row"))
    key = [F.col(f"_in{i}") for i in range(len(group))] + [F.col(f"_by{i}") for i in range(len(order))]
    dealt = flat.repartitionByRange(*key).sortWithinPartitions(*key).select(*[f"_in{i}" for i in range(len(taken))], "_row")
    n = len(sums) + len(xors)
    extra = "".join(f", _acc{i} bigint" for i in range(n))
    kind = dealt.schema["_row"].dataType.simpleString()
    done = staged(dealt.mapInArrow(_accumulated(len(group), len(sums), len(xors)), ", ".join(f"_in{i} bigint" for i in range(len(taken))) + f", _row {kind}, _n bigint{extra}, _part bigint, _tail boolean"), "running")
    tails = sorted(tuple(r) for r in done.filter("_tail").select("_part", *[f"_in{i}" for i in range(len(group))], "_n", *[f"_acc{i}" for i in range(n)]).collect())
    carried, open_group, totals = [], None, None
    for tail, following in zip(tails, tails[1:]):
        own, values = tail[1:1 + len(group)], tail[1 + len(group):]
        if own == open_group:
            values = tuple((a ^ b) if i > len(sums) else a + b for i, (a, b) in enumerate(zip(totals, values)))
        open_group, totals = own, values
        carried.append((following[0], *own, *values))
    fields = ["_p", *[f"_g{i}" for i in range(len(group))], "_cn", *[f"_c{i}" for i in range(n)]]
    carries = done.sparkSession.createDataFrame(carried, ", ".join(f"{f} bigint" for f in fields))
    on = F.col("_part") == F.col("_p")
    for i in range(len(group)):
        on &= F.col(f"_in{i}") == F.col(f"_g{i}")
    met = done.join(F.broadcast(carries), on, "left")       # at most one row a range
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = [F.col(f"_acc{i}").bitwiseXOR(zero(f"_c{i}")).alias(c) if c in xors else (F.col(f"_acc{i}") + zero(f"_c{i}")).alias(c) for i, c in enumerate([*sums, *xors])]
    return met.select("_row.*", (F.col("_n") + zero("_cn")).alias(rank), *named)

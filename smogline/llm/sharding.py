"""Sharding by minimax contiguous partition.

Equal texts form an atomic group.  Groups stand in one fixed order (first document id, then
digest) and are cut into contiguous shards so that the largest shard is as small as any
contiguous cut allows.  The smallest capacity is found by search: a capacity is feasible when
packing greedily needs no more than the wanted number of shards.  The search never sees
groups, only prefix sums that Spark looks up, for many capacities in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from smogline.llm.common import digest, staged

BUCKETS = 1024      # pieces of the group order whose sums are added up; bounds the broadcast table
SALTS = 64          # pieces of a group of copies when its rows are numbered
CANDIDATES = 64     # capacities tried in one job


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _ordered_prefixes(groups: DataFrame) -> DataFrame:
    """Groups with the bytes and rows up to and including each, in order.

    Groups are dealt to buckets by quantiles of ``first``; the groups without a document id, all before
    the others, by their digest.  A window sums inside each bucket, and the sums of the at most
    ``2 * BUCKETS`` earlier buckets are added.
    """
    marks = groups.agg(F.percentile_approx("first", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(20_000)).alias("m")).first()["m"]
    edges = F.array(*[F.lit(x) for x in sorted(set(marks or []))]).cast("array<long>")
    place = F.when(F.col("first").isNull(), F.pmod(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("long"), F.lit(65536)) * F.lit(BUCKETS) / F.lit(65536) - F.lit(BUCKETS) - 1)
    table = groups.withColumn("bucket", place.otherwise(_bisect(edges, F.col("first"))).cast("long"))
    sums = table.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("bucket").orderBy(F.col("first").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, 0)
    return (table.withColumn("b1", F.sum("bytes").over(inside)).withColumn("r1", F.sum("rows").over(inside))
            .join(F.broadcast(bases), "bucket")     # at most 2 * BUCKETS rows
            .select("digest", "first", "bytes", "rows", (F.col("b0") + F.col("b1")).alias("bytes_to"), (F.col("r0") + F.col("r1")).alias("rows_to")))


def _bisect(edges: Column, value: Column) -> Column:
    """How many of the edges lie below the value."""
    return F.size(F.filter(edges, lambda e: e < value)).cast("long")


def _greedy(groups: DataFrame, capacities: list[int], shards: int, whole: int) -> list[list[int]]:
    """For each capacity the ends (in bytes) of the shards that greedy packing fills, at most ``shards``."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        wanted = [e[-1] + c for e, c in zip(ends, capacities)]
        row = groups.agg(*[F.max(F.when(F.col("bytes_to") <= w, F.col("bytes_to"))).alias(f"e{i}") for i, w in enumerate(wanted)]).first()
        for e, found in zip(ends, row):
            e.append(found if found is not None else e[-1])
        if all(e[-1] == whole for e in ends):
            break
    return [e[1:] for e in ends]


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity for which greedy packing needs no more than ``shards`` shards, and its shard ends.

    ``groups`` has bytes and bytes_to.  No capacity below both the largest group and the even share can do;
    their sum always does.  Each round tries ``CANDIDATES`` capacities at once and keeps the gap between the
    last that fails and the first that does.
    """
    most, whole = groups.agg(F.coalesce(F.max("bytes"), F.lit(0)), F.coalesce(F.max("bytes_to"), F.lit(0))).first()
    if not whole:
        return 0, [0] * shards
    low = max(most, -(-whole // shards)) - 1        # may fail
    high = -(-whole // shards) + most               # never fails
    best: list[int] = []
    while high - low > 1 or not best:
        step = max(1, (high - low) // CANDIDATES)
        tried = sorted({*range(low + step, high, step), high})
        for capacity, ends in zip(tried, _greedy(groups, tried, shards, whole)):
            if ends[-1] == whole:
                high, best = capacity, ends
                break
            low = capacity
    return high, best + [whole] * (shards - len(best))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard) for every row.

    All rows with equal texts lie in one shard; shards are contiguous in the order of the groups' smallest
    document id.  Null texts are a group with the empty text.  Rows with a null or repeated id keep their
    own slots; which of two equal rows gets which slot is open.  An empty table gives an empty result.

    A group of copies may be any share of the rows: it is summed before the shuffle and its
    rows are numbered in ``SALTS`` pieces by a hash of the id.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(F.col(key).alias("doc_id"), size_bytes(F.col(text)).alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), digest(t).alias("digest"),
                              F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt")), "shard-rows")
    parts = staged(rows.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first")), "shard-parts")
    groups = staged(_ordered_prefixes(parts.groupBy("digest").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"))), "shard-groups")
    _, ends = smallest_capacity(groups, shards)
    shard = total_below(ends, F.col("bytes_to"))
    starts = {r["shard"]: r["s"] for r in groups.groupBy(shard.alias("shard")).agg(F.min(F.col("rows_to") - F.col("rows")).alias("s")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)) for i in range(shards)]), F.col("shard") + 1)
    earlier = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)     # at most SALTS rows
    placed = (parts.select("digest", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
              .join(groups.select("digest", shard.alias("shard"), (F.col("rows_to") - F.col("rows")).alias("rows_from")), "digest")
              .select("digest", "salt", "shard", (F.col("rows_from") - start + F.col("ahead")).alias("base")))
    number = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id"))
    return (rows.withColumn("number", number).join(placed, ["digest", "salt"])
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("number") - 1).cast("long").alias("slot")))


def total_below(ends: list[int], bytes_to: Column) -> Column:
    """Shard number: how many of the shard ends lie before the group's last byte."""
    return F.least(sum(((bytes_to > F.lit(e)).cast("int") for e in ends), F.lit(0)), F.lit(len(ends) - 1))

"""Near copies by the Jaccard similarity of five-word shingles: MinHash cells and prefixes find candidates, exact sets decide.

A set's 180 minima form 30 cells of six: two sets of similarity 0.8 miss each other in every cell once in 9,000 times, more similar ones
less often.  Four bits of each minimum form a sketch; sets of similarity 0.8 agree in 146 of them on average and
pairs that agree in fewer than 126 are passed over, at 0.8 once in 10,000 times.  What is left is compared set by set.

Texts that share a cell but not a group meet by their prefixes: with all shingles in one order, rare ones first, two sets of
similarity 0.8 share a shingle among the first fifth of either, and no more than what stands from there on.
Copies of one text that were edited apart have shingles of their own in front and do not meet, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import by_sorting, staged
from smogline.llm.components import components

CELLS = 30
ROWS = 6
SKETCH_BITS = 4         # of each minimum
AGREEING = 126
WORDS = 3               # longs that hold one bit of each minimum
_RANDOM = np.random.default_rng(5).integers(0, 2**64, (2, CELLS * ROWS), dtype=np.uint64)
_FACTORS, _TERMS = _RANDOM[0] | np.uint64(1), _RANDOM[1]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def five_word_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles, given the hashes of the four-word ones in order; a shorter text is one shingle."""
    if len(hashes) < 2:
        return hashes
    first, second = hashes[:-1], hashes[1:]
    mixed = (first ^ (first >> np.uint64(29))) * _ODD + ((second << np.uint64(31)) | (second >> np.uint64(33)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """Cells and sketch (for each of the bits, the longs that hold it for all minima), as signed numbers; a text without words has no cells."""
    if not len(shingles):
        return [], [0] * (SKETCH_BITS * WORDS)
    least = np.full(CELLS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):        # bounded memory for long texts
        np.minimum(least, (_FACTORS[:, None] * shingles[at: at + 1024] + _TERMS[:, None]).min(axis=1), out=least)
    cells = np.arange(1, CELLS + 1, dtype=np.uint64)
    for column in least.reshape(CELLS, ROWS).T:
        cells = (cells ^ column) * _ODD
        cells ^= cells >> np.uint64(29)
    planes = np.zeros((SKETCH_BITS, 64 * WORDS), dtype=np.uint8)
    planes[:, :CELLS * ROWS] = (least >> np.arange(40, 40 + SKETCH_BITS, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return cells.view(np.int64).tolist(), np.packbits(planes, axis=1).view(np.int64).ravel().tolist()


def _alike(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether sizes and sketches allow a similarity of 0.8."""
    def unlike(word: int) -> Column:
        places = [F.get(a("sketch"), word + WORDS * bit).bitwiseXOR(F.get(b("sketch"), word + WORDS * bit)) for bit in range(SKETCH_BITS)]
        return F.bit_count(reduce(Column.bitwiseOR, places))
    differing = sum((unlike(w) for w in range(1, WORDS)), unlike(0))
    return (5 * F.least(a("size"), b("size")) >= 4 * F.greatest(a("size"), b("size"))) & (differing <= CELLS * ROWS - AGREEING)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the groups of those pairs of sets whose similarity is 0.8 or more."""
    left, right = sets.select(F.col("copy").alias("x"), F.col("shingles").alias("xs")), sets.select(F.col("copy").alias("y"), F.col("shingles").alias("ys"))
    met = pairs.join(by_sorting(left), "x").join(by_sorting(right), "y")
    return met.filter(9 * F.size(F.array_intersect("xs", "ys")) >= 4 * (F.size("xs") + F.size("ys"))).select("a", "b").distinct()


def _pairs(met: DataFrame, a: Callable[[str], Column], b: Callable[[str], Column]) -> DataFrame:
    """(x, y, a, b): distinct pairs of sets, the smaller first, with their groups."""
    ends = [F.struct(side("copy").alias("copy"), side("root").alias("root")) for side in (a, b)]
    low, high = F.least(*ends), F.greatest(*ends)
    return met.select(low["copy"].alias("x"), high["copy"].alias("y"), low["root"].alias("a"), high["root"].alias("b")).distinct()


def _prefixes(sets: DataFrame) -> DataFrame:
    """(copy, place, shingle): of each set the shingles among which a set of similarity 0.8 has one too, by their place from 0.

    The order is one for all sets: by the number of sets that hold a shingle, then by the shingle.
    """
    single = sets.select("copy", F.explode("shingles").alias("shingle"))
    held = single.groupBy("shingle").agg(F.count("*").alias("n"))
    ordered = by_sorting(single).join(held, "shingle").groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    first = F.slice("s", 1, F.size("s") - F.ceil(F.size("s") * 4 / 5).cast("int") + 1)
    return ordered.select("copy", F.posexplode(first).alias("place", "at")).filter("at.n > 1").select("copy", "place", "at.shingle")


def _sharing_prefix(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (l, r) of texts of different groups that share a shingle of their prefixes early enough for a similarity of 0.8.

    Of the texts at one shingle, those of the group that most of them belong to do not meet each other.
    """
    keyed = staged(_prefixes(by_sorting(sets).join(texts, "copy", "left_semi")).join(by_sorting(texts), "copy"), "near-prefixes")
    sizes = keyed.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups")).filter("groups > 1").drop("groups")
    strays = by_sorting(keyed).join(main, "shingle").filter("root != main").drop("main")
    left, right = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    shared = 9 * F.least(left("size") - left("place"), right("size") - right("place")) >= 4 * (left("size") + right("size"))
    return strays.alias("l").join(by_sorting(keyed).alias("r"), (left("shingle") == right("shingle")) & (left("root") != right("root")) & shared & _alike(left, right))


def joined_groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(root, top): the groups that links of similarity 0.8 or more join with others, and the least group reachable.

    ``nodes`` has copy (key of a distinct text), root (its group so far), size (of its set), sketch and cells.  ``sets_of``
    gives (copy, shingles) for a table of copies.  First every member of a cell meets one centre, the text of the widest reach in it,
    which joins large groups with rows in proportion to their number; then the texts of cells that still hold
    several groups meet those of other groups at the shingles of their prefixes.
    """
    cells = nodes.select("copy", "root", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("cell")
    met = staged(by_sorting(cells).join(shared, "cell"), "near-met")
    live = staged(by_sorting(met).join(nodes.select("copy", "size", "sketch"), "copy"), "near-cells")
    sets = staged(sets_of(live.select("copy").distinct()), "near-sets")
    fields = ("copy", "root", "size", "sketch")
    # the text that shares cells with the most others is the likeliest to be what the others were made from
    reach = by_sorting(live).join(live.groupBy("cell").agg(F.count("*").alias("n")), "cell").groupBy("copy").agg(F.sum("n").alias("reach"))
    middle = F.max_by(F.struct(*fields), F.struct("reach", F.xxhash64("cell", "copy")))
    centres = staged(by_sorting(live).join(reach, "copy").groupBy("cell").agg(middle.alias("c")), "near-centres")
    own, centre = (lambda n: F.col(n)), (lambda n: F.col("c")[n])
    stars = by_sorting(live).join(centres, "cell").filter((own("root") != centre("root")) & _alike(own, centre))
    groups = staged(components(_verified(_pairs(stars, own, centre), sets)), "near-stars")
    grouped = by_sorting(live).join(groups.select(F.col("node").alias("root"), "component"), "root", "left").withColumn("group", F.coalesce("component", "root")).drop("component")
    grouped = staged(grouped, "near-grouped")
    main = centres.select("cell", F.col("c.copy").alias("copy")).join(by_sorting(grouped.select("cell", "copy", F.col("group").alias("main"))), ["cell", "copy"]).select("cell", "main")
    split = by_sorting(grouped).join(main, "cell").filter("group != main").select("cell").distinct()
    unlike = by_sorting(grouped).join(split, "cell", "left_semi").select("copy", F.col("group").alias("root"), "size", "sketch").dropDuplicates(["copy"])
    rest = _sharing_prefix(staged(unlike, "near-unlike"), sets)
    left, right = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    tops = components(_verified(_pairs(rest, left, right), sets)).withColumnsRenamed({"node": "group", "component": "top"})
    return grouped.select("root", "group").distinct().join(tops, "group", "left").select("root", F.coalesce("top", "group").alias("top"))

"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the vector of their bit counts (0 to 2) is the
embedding.  Dense groups are joined first by stars over aligned four-bit groups of the raw fingerprint; the grid over the embedding finds all other links.  The Manhattan distance of two vectors never exceeds the number of differing bits, so it
bounds the search: vectors are laid on a grid, close ones are range-joined cell by cell, and
only pairs within the bound are verified on the fingerprints.

The counts are kept in thermometer code (0: 00, 1: 01, 2: 11), where the Manhattan distance is the number
of differing code bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import by_sorting, staged
from smogline.llm.components import components
from smogline.llm.jaccard import five_word_set, joined_groups, signature

SHINGLE = 4
SEED = 42
LIMIT = 4
BANDS = 7
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ONES = 0x5555555555555555


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of the shingles in order, none without words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[SHINGLE - 1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n)


def _folded(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):     # bounded memory for long texts
        counts += np.unpackbits(hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as an unsigned number: bit set if in over half of the shingles' hashes."""
    return _folded(_shingle_hashes(_words(text)))


def _fingerprints(batches):
    for batch in batches:
        prints = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column(batch.num_columns - 1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "bits"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits) per row; bits is the fingerprint as a signed long."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, bits bigint")


def counts_code(bits: Column) -> Column:
    """The bit counts of the 32 two-bit segments in thermometer code."""
    ones = F.lit(_ONES)
    next_bit = F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(next_bit).bitwiseAND(ones).bitwiseOR(F.shiftleft(bits.bitwiseAND(next_bit).bitwiseAND(ones), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(bands: int, limit: int) -> list[int]:
    """Masks over the code: the bands of which every combination leaves ``limit`` bands out."""
    edges = [round(32 * i / bands) for i in range(bands + 1)]
    band = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(band[i] for i in chosen)) for chosen in combinations(range(bands), bands - limit)]


def _neighbour_links(prints: DataFrame) -> DataFrame:
    """Links between fingerprints that differ inside one aligned four-bit group, as stars.

    All members of such a set differ in four bits at most, so a star to the smallest holds all its links.  This joins the
    many fingerprints of a large group of near copies with rows in proportion to their number.
    """
    keyed = prints.select("bits", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("bits").bitwiseAND(F.lit(_signed(~(15 << (4 * i)) & (2**64 - 1)))).alias("rest")) for i in range(16)])).alias("k"))
    least = keyed.groupBy("k").agg(F.min("bits").alias("a"), F.max("bits").alias("z")).filter("a != z").select("k", "a")
    return by_sorting(keyed).join(least, "k").select("a", F.col("bits").alias("b")).filter("a != b").distinct()


def _joined(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(bits, root): the component of each fingerprint under the links."""
    found = components(links)
    return by_sorting(prints.select("bits")).join(found.withColumnRenamed("node", "bits"), "bits", "left").select("bits", F.coalesce("component", "bits").alias("root"))


def link_fingerprints(prints: DataFrame, limit: int = LIMIT, bands: int = BANDS) -> DataFrame:
    """(bits, root) for distinct fingerprints: root is the least fingerprint reachable over links of up to ``limit`` bits.

    Grid: the 32 counts form ``bands`` bands.  Vectors within Manhattan distance ``limit`` differ in at most ``limit`` bands, so
    they agree in some ``bands - limit`` of them: the pair meets in that cell.  Each fingerprint stands in one cell for every such
    choice of bands; more bands mean more rows but smaller cells (the default suits 10^8 distinct fingerprints, 8 bands 10^10).
    Pairs already joined by neighbour stars are passed over, so a dense group does not yield all its pairs.
    """
    if limit < LIMIT:
        raise ValueError("neighbour stars link up to four bits; a smaller limit would be exceeded")
    near = staged(_joined(prints, staged(_neighbour_links(prints), "simhash-stars")), "simhash-near")
    masks = F.array(*[F.struct(F.lit(i).alias("c"), F.col("code").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_cells(bands, limit))])
    cells = near.withColumn("code", counts_code(F.col("bits"))).select("bits", "root", "code", F.explode(masks).alias("cell"))
    left, right = by_sorting(cells).alias("l"), cells.alias("r")
    pairs = (left.join(right, (F.col("l.cell") == F.col("r.cell")) & (F.col("l.bits") < F.col("r.bits")) & (F.col("l.root") != F.col("r.root"))
                       & (F.bit_count(F.col("l.code").bitwiseXOR(F.col("r.code"))) <= limit)         # Manhattan distance
                       & (F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= limit))        # verified
             .select(F.col("l.root").alias("a"), F.col("r.root").alias("b")).distinct())
    roots = components(pairs).withColumnsRenamed({"node": "root", "component": "top"})
    return by_sorting(near).join(roots, "root", "left").select("bits", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for every row.

    Words are runs of characters other than ASCII white space, A-Z in lower case; shingles are four words with one space
    between, a shorter text is one shingle, a text without words (or null) has fingerprint zero and links like any other.
    Exact copies share a fingerprint and meet once.  Rows with a null id get the component of their fingerprint; a component
    without any id is null.  Repeated rows stay.
    """
    rows = staged(fingerprints(docs, key, text), "simhash-rows")
    prints = staged(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = staged(link_fingerprints(prints), "simhash-roots")
    first = by_sorting(prints).join(roots, "bits").groupBy("root").agg(F.min("first").alias("component_id"))
    named = by_sorting(roots).join(first, "root").select("bits", "component_id")
    return by_sorting(rows).join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _pieces(batches, rows: int = 256):
    """The batches in small pieces, so that few texts and shingle sets stand in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _shapes(batches):
    for batch in _pieces(batches):
        found = []
        for text in batch.column(batch.num_columns - 1):
            words = _words(text.as_py())
            hashes = _shingle_hashes(words)
            shingles = five_word_set(hashes)
            found.append((xxhash.xxh64_intdigest(b" ".join(words), SEED + 1), _folded(hashes), len(shingles), *signature(shingles)))
        copies, bits, sizes, cells, sketches = zip(*found)
        signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (copies, bits)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *signed, pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                                         names=[*batch.schema.names[:-1], "copy", "bits", "size", "cells", "sketch"])


def _sets(batches):
    for batch in _pieces(batches):
        sets = [five_word_set(_shingle_hashes(_words(t.as_py()))).view(np.int64) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["copy", "shingles"])


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of the smallest id of each group (of several texts with that id, one); documents without an id stay.

    A row goes by its id and text together: of two rows with one id, only the text that belongs to the group goes.  A row
    that stands twice in the table, id and text, is one document and stays or goes as one.

    Two documents are near copies if their fingerprints differ in four bits at most, as in :func:`near_duplicates`, or if the Jaccard
    similarity of their five-word shingles is 0.8 or more; a group is what such links reach.  At 0.8 fingerprints of usual
    texts differ in 5 to 13 bits, which no choice of bands finds at bearable cost: MinHash cells
    propose those pairs and the sets decide (:mod:`smogline.llm.jaccard`).
    """
    read = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("raw"), F.col(text).alias("_text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = staged(read.mapInArrow(_shapes, f"doc_id {kind}, raw bigint, copy bigint, bits bigint, size bigint, cells array<bigint>, sketch array<bigint>"), "near-shapes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first")
    texts = staged(rows.groupBy("copy").agg(first, *[F.any_value(c).alias(c) for c in ("bits", "size", "cells", "sketch")]), "near-texts")
    roots = link_fingerprints(staged(texts.select("bits").distinct(), "near-prints"))
    nodes = staged(by_sorting(texts).join(roots, "bits"), "near-nodes")

    def sets_of(copies: DataFrame) -> DataFrame:
        wanted = by_sorting(nodes).join(copies, "copy", "left_semi").select("copy", F.col("first.doc_id").alias("k"), F.col("first.raw").alias("r"))
        met = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("raw") == F.col("r"))).select("copy", "_text")
        return met.mapInArrow(_sets, "copy bigint, shingles array<bigint>").groupBy("copy").agg(F.any_value("shingles").alias("shingles"))

    named = staged(by_sorting(nodes).join(joined_groups(nodes, sets_of), "root", "left").select("copy", "first", F.coalesce("top", "root").alias("top")), "near-groups")
    kept = named.groupBy("top").agg(F.min("first").alias("kept"))
    found = rows.filter("doc_id IS NOT NULL").join(by_sorting(by_sorting(named).join(kept, "top").select("copy", "kept")), "copy")
    gone = found.filter((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("raw") != F.col("kept.raw"))).select(F.col("doc_id").alias("_gone"), "raw").distinct()
    return docs.join(gone, (F.col(key) == F.col("_gone")) & (F.xxhash64(F.col(text)) == F.col("raw")), "left_anti")

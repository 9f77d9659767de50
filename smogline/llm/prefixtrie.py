"""Conversation prefix trie by whole-sequence collapse.

Identical conversations become one weighted sequence with a list of the conversations that end there.  Sequences that are proper
prefixes of another one leave by anti-join; what stays are the leaves.  The prefixes of the sequences, added up with their weights, are the
nodes of the trie.  No tree is built anywhere: a node is the 128-bit key of its turns, and all counts are sums over prefixes.

Turns are digested where they are read, so texts are never shuffled.  The key of a prefix is the XOR of its turns' digests taken with their
positions, so a conversation may span any number of tasks (:mod:`smogline.llm.running`).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from smogline.llm.common import staged
from smogline.llm.running import running

GROUP = 5           # conversations of one donor
SPAN = 9            # remainders that say how many turns are taken from the donor
CHUNK = 4096        # conversation ids put into one piece of an end list
NODE = ("depth", "k1", "k2")


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, rank, t1, t2, bytes): the place of every turn in its conversation, its digest, and the UTF-8 bytes of its text.

    Null turns come first, equal ones in the order of role and then of the digest; a null role or text is empty.  Rows without a conversation
    belong to none and are left out.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    read = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), said[0].alias("role"), F.octet_length(said[1]).cast("long").alias("bytes"),
                                                        F.xxhash64(F.lit(1), *said).alias("t1"), F.xxhash64(F.lit(2), *said, F.lit(3)).alias("t2"))
    order = [F.col("turn"), F.col("role"), F.col("t1"), F.col("t2"), F.col("bytes")]
    return running(read, ["c"], order).select("c", "rank", "t1", "t2", "bytes")


def rebuilt(ranked: DataFrame, group: int = GROUP, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The turns (c, pos, t1, t2, bytes) and lengths (c, len) of the rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % span, and then its own turns after its first h.
    """
    lens = staged(ranked.groupBy("c").agg(F.count("*").alias("n")), "trie-lengths")
    taken = (F.crc32(F.col("c").cast("string")) % span).alias("h")
    donors = lens.select(F.col("c").alias("donor"), F.col("n").alias("given"))
    plan = staged(lens.select("c", "n", taken, (F.col("c") - F.col("c") % group).alias("donor")).join(donors, "donor", "left")
                  .select("c", "n", "h", "donor", F.least("h", F.coalesce("given", F.lit(0))).alias("m")), "trie-plan")
    own = ranked.join(plan.select("c", "h", "m"), "c").filter("rank > h").select("c", (F.col("rank") - F.col("h") + F.col("m")).alias("pos"), "t1", "t2", "bytes")
    heads = plan.filter("m > 0").select(F.col("c").alias("to"), F.col("donor").alias("c"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("rank"))
    lent = ranked.filter(F.col("rank") < span).join(heads, ["c", "rank"]).select(F.col("to").alias("c"), F.col("rank").alias("pos"), "t1", "t2", "bytes")
    return own.unionByName(lent), plan.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _streamed_hash(batches):
    """One digest for each run of equal keys in (k1, k2, depth, chunk) order, over the pieces with commas between."""
    now, state, done = None, None, []
    for batch in batches:
        for depth, k1, k2, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, k1, k2) != now:
                done += [(*now, state.hexdigest())] if now else []
                now, state = (depth, k1, k2), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*NODE, "ends_sha256"])


def end_pieces(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, chunk, piece): the end list of each sequence, ids ascending and comma-joined, cut into pieces of bounded length."""
    ranked = running(ends.select(F.col("len").alias("depth"), "k1", "k2", "c"), list(NODE), [F.col("c")])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    return ranked.groupBy(*NODE, F.floor((F.col("rank") - 1) / CHUNK).alias("chunk")).agg(ids.alias("piece"))


def _end_hashes(pieces: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256).  A list of one piece is hashed where it stands; a longer one is streamed piece by piece."""
    pieces = staged(pieces, "trie-pieces")
    long = pieces.filter("chunk = 1").select(*NODE)
    one = pieces.join(long, list(NODE), "left_anti").select(*NODE, F.sha2("piece", 256).alias("ends_sha256"))
    many = pieces.join(long, list(NODE), "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "chunk", "piece")
    return one.unionByName(many.mapInArrow(_streamed_hash, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (c, pos, t1, t2, bytes) with positions from 1, ``lengths`` (c, len) for every conversation, turnless ones included.
    No conversations give no nodes, not even a root.

    saved_tokens of a subtree: each node counts at its smallest member's sequence, whose deeper nodes then count there too.  A node's
    subtree is thus the rest of that sequence from the node on, and the whole of what counts at its other sequences.
    """
    at = [F.xxhash64(F.lit(i), "pos", t) for i, t in ((1, "t1"), (2, "t2"))]
    marked = turns.select("c", "pos", "bytes", at[0].alias("a1"), at[1].alias("a2"))
    prefixes = staged(running(marked, ["c"], [F.col("pos"), F.col("a1"), F.col("a2"), F.col("bytes")], xors={"k1": "a1", "k2": "a2"}, rank="depth")
                      .select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("a1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("a2")).alias("p2"), "bytes"), "trie-prefixes")
    # whole-sequence collapse
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    ends = staged(lengths.join(prefixes.select("c", F.col("depth").alias("len"), "k1", "k2"), ["c", "len"], "left").select("c", "len", zero("k1"), zero("k2")), "trie-ends")
    sequences = staged(ends.groupBy(F.col("len").alias("depth"), "k1", "k2").agg(F.min("c").alias("c"), F.count("*").alias("w")), "trie-sequences")
    own = staged(prefixes.join(sequences.select("c", "w", F.col("depth").alias("len")), "c"), "trie-own")
    nodes = staged(own.groupBy(*NODE).agg(F.sum("w").alias("n_convs"), F.min("c").alias("conv_id"), F.max(F.col("depth") < F.col("len")).alias("inner"),
                                          *[F.any_value(x).alias(x) for x in ("p1", "p2", "bytes")]), "trie-nodes")
    leaves = sequences.filter("depth > 0").join(nodes.filter("inner").select(*NODE), list(NODE), "left_anti").select("c", F.lit(1).alias("leaf"))
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    totals = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum(worth).alias("total"))
    counted = sequences.select("c").join(leaves, "c", "left").join(totals, "c", "left").select("c", F.coalesce("leaf", F.lit(0)).alias("leaf"), zero("total"))
    sums = own.select("c", *NODE).join(counted, "c").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("total").alias("reached"))
    rest = running(nodes.select("conv_id", *NODE, worth.alias("worth")), ["conv_id"], [-F.col("depth")], sums={"below": "worth"}).select(*NODE, "below")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    found = staged(nodes.drop("inner").join(sums, list(NODE)).join(rest, list(NODE)).join(totals.withColumnRenamed("c", "conv_id"), "conv_id"), "trie-found")
    whole = ends.agg(F.count("*").alias("n"), F.min("c").alias("c")).first()
    top = F.when(F.col("depth") == 1, F.lit(whole["c"])).otherwise(F.col("parent")).cast("long")
    body = (found.join(children, list(NODE), "left").join(parents, ["depth", "p1", "p2"], "left")
            .select(*NODE, "conv_id", top.alias("parent_conv_id"), "n_convs", zero("n_children"), "n_leaves", (F.col("reached") - F.col("total") + F.col("below")).alias("saved_tokens")))
    long = lambda v: F.lit(v).cast("long")
    root = (nodes.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.coalesce(F.sum(worth), F.lit(0)).alias("saved_tokens"))
            .select(long(0).alias("depth"), long(0).alias("k1"), long(0).alias("k2"), long(whole["c"]).alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
                    long(whole["n"]).alias("n_convs"), "n_children", long(max(1, leaves.count())).alias("n_leaves"), "saved_tokens"))
    every = body.unionByName(root) if whole["n"] else body
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(_end_hashes(end_pieces(ends)), list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def sql_crc32(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a string's UTF-8 bytes."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)")


def check_sql(group: int = GROUP, span: int = SPAN) -> str:
    """The same nodes in DuckDB SQL, with whole prefixes as keys."""
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn,
                  coalesce(role, '') || chr(1) || md5(coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes
           FROM conversations WHERE conv_id IS NOT NULL),
lens AS (SELECT c, count(*) AS n, {sql_crc32('c::VARCHAR')} % {span} AS h FROM t GROUP BY c),
plan AS (SELECT l.c, l.h, l.c - l.c % {group} AS donor, least(l.h, coalesce(d.n, 0)) AS m FROM lens l LEFT JOIN lens d ON d.c = l.c - l.c % {group}),
turns AS (SELECT p.c, t.rn AS pos, said, bytes FROM plan p JOIN t ON t.c = p.donor AND t.rn <= p.h
          UNION ALL SELECT p.c, t.rn - p.h + p.m, said, bytes FROM plan p JOIN t ON t.c = p.c AND t.rn > p.h),
pre AS (SELECT c, pos AS depth, list(said) OVER (PARTITION BY c ORDER BY pos) AS k, bytes FROM turns
        UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM lens),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS hash FROM (SELECT c, arg_max(k, depth) AS k FROM pre GROUP BY c) GROUP BY k),
nodes AS (SELECT k, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM pre GROUP BY k),
kids AS (SELECT k[:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT n.k[:a.i] AS k, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
       FROM nodes n LEFT JOIN kids ON kids.k = n.k, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS i) a GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
       up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, coalesce(ends.hash, sha256('')) AS ends_sha256
FROM nodes n JOIN up ON up.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.k[:n.depth - 1]"""

"""License scans by diagonal voting.

All rolling hashes of two words of the documents are joined to the positions where license phrases hold them.  A hit votes for
the diagonal (document position minus phrase position); the votes of a diagonal are a bit mask of matched phrase positions, so
they are combined before the shuffle and repeated rows change nothing.  Neighbouring diagonals (a word left out or put in) are
merged, and a span is verified by the share of the phrase that it covers; base phrases need all of it on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from smogline.llm.common import digest, staged

GRAM = 2
DRIFT = 2           # diagonals this close to the one before belong to one span
COVERED = 0.8       # share of a phrase's grams that a span needs
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are counted place by place, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Phrases of common license notices and the labels this scan adds.
NOTICES = {
    "cc by nc 4 0": "cc-by-nc", "cc by sa 4 0": "cc-by-sa", "cc by nd 4 0": "cc-by-nd",
    "creative commons attribution 4 0 international license": "cc-by-4",
    "creative commons attribution share alike 4 0 international license": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "work is licensed under the gnu general public license": "gpl-notice",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "released under the mit license": "mit", "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2", "eclipse public license version 2 0": "epl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}


def words_of(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs of ASCII letters, digits and any other non-ASCII characters.

    ``lower`` also changes letters outside ASCII.  They are word characters before and after, so the words begin and end
    at the same places; only a word with such a letter could differ, and no phrase has one.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def _grams(words: Column) -> Column:
    """Hash of every two consecutive words."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def phrase_table(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    """(phrase, label, base, grams, position, gram): one row per position of each phrase; phrases have 2 to 64 words."""
    rows = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in (NOTICES if notices is None else notices).items()]
    if any(not 1 < len(p.split()) <= 64 for p, _, _ in rows):
        raise ValueError("phrases must have 2 to 64 words")
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{p}', '{label}', {str(base).lower()})" for i, (p, label, base) in enumerate(rows)) + " AS t(phrase, text, label, base)")
    words = F.split("text", " ")
    return table.select("phrase", "label", "base", (F.size(words) - 1).alias("grams"), F.posexplode(_grams(words)).alias("position", "gram"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for every row.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start (null without one).
    labels also holds the labels of notices; score is the best share of a phrase that was covered (0 without a label).  spans
    lists (label, start, words, covered) by start.  A null or empty text has no words and no labels; null keys and repeated rows keep their rows.

    The phrase table is broadcast: its size is fixed by the phrases, not by the documents.  Hits are few and their masks are combined
    before the shuffle; documents are matched to them by key and text digest.
    """
    phrases = phrase_table(docs.sparkSession, notices)
    rows = docs.select(F.col(key).alias("_key"), digest(F.col(text)).alias("_text"), words_of(F.col(text)).alias("_words"))
    sizes = staged(rows.select("_key", "_text", F.size("_words").cast("long").alias("n_words")), "license-sizes")
    grams = rows.select("_key", "_text", F.posexplode(_grams(F.col("_words"))).alias("at", "gram"))
    hits = grams.join(F.broadcast(phrases), "gram")
    votes = (hits.groupBy("_key", "_text", "phrase", "label", "base", "grams", (F.col("at") - F.col("position")).cast("long").alias("diagonal"))
             .agg(F.bit_or(F.expr("shiftleft(1L, position)")).alias("mask")))
    votes = staged(votes, "license-votes")
    full = F.bit_count("mask") == F.col("grams")
    # neighbouring diagonals of one phrase form a span; whole matches stay spans of their own
    line = Window.partitionBy("_key", "_text", "phrase").orderBy("diagonal")
    loose = votes.filter(~full).withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT).cast("int"), F.lit(1)))
    loose = loose.withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = (loose.groupBy("_key", "_text", "phrase", "label", "base", "grams", "span").agg(F.bit_or("mask").alias("mask"), F.min("diagonal").alias("diagonal"))
              .filter(~F.col("base") & (F.bit_count("mask") >= COVERED * F.col("grams"))).drop("span"))
    spans = votes.filter(full).unionByName(merged)
    span = F.struct(F.greatest("diagonal", F.lit(0)).alias("start"), F.col("label"), (F.col("grams") + 1).alias("words"), (F.bit_count("mask") / F.col("grams")).alias("covered"))
    place = F.when(F.col("base"), F.col("diagonal"))
    found = spans.groupBy("_key", "_text").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        _joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"), _joined(F.collect_set("label")).alias("labels"),
        F.max(F.bit_count("mask") / F.col("grams")).alias("score"), F.sort_array(F.collect_list(span)).alias("spans"))
    met = sizes.alias("d").join(found.alias("f"), F.col("d._key").eqNullSafe(F.col("f._key")) & (F.col("d._text") == F.col("f._text")), "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return met.select(F.col("d._key").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def check_sql() -> str:
    """The scan without hashes, for engines that unnest lists: pairs of words, diagonals, masks, spans."""
    values = ", ".join(f"({i}, '{p}', '{label}', {base})" for i, (p, label, base) in enumerate([(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in NOTICES.items()]))
    return rf"""
    WITH p AS (SELECT *, string_split(phrase, ' ') AS w FROM (VALUES {values}) t(id, phrase, label, base)),
    pg AS (SELECT id, label, base, len(w) - 1 AS grams, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM p)),
    d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, i - 1 AS spot, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
    v AS (SELECT doc_id, id, label, base, grams, spot - pos AS diagonal, bit_or(CAST(1 AS BIGINT) << pos) AS mask
          FROM g JOIN pg USING (a, b) GROUP BY ALL),
    l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS span FROM (
          SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS new
          FROM v WHERE bit_count(mask) <> grams)),
    m AS (SELECT doc_id, label, base, grams, min(diagonal) AS diagonal, bit_or(mask) AS mask FROM l WHERE NOT base GROUP BY doc_id, id, label, base, grams, span),
    s AS (SELECT doc_id, label, base, grams, diagonal, mask FROM v WHERE bit_count(mask) = grams
          UNION ALL SELECT doc_id, label, base, grams, diagonal, mask FROM m WHERE bit_count(mask) >= {COVERED} * grams),
    f AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
          coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
          array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(bit_count(mask) / CAST(grams AS DOUBLE)) AS score FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
    FROM d LEFT JOIN f USING (doc_id)"""

"""Substring dedup by hashing lines and their sentences.

A unit is a sentence of a line: lines end at a newline, sentences after ``.``, ``!`` or ``?`` and a space, so a line without those is one unit.  Units are
normalised (lower case; everything but letters and digits is one space) and digested; of all units with one digest, in the whole table, the
first by (document key, place) stays.  The later ones are cut out where they form runs of neighbours that hold ``RUN_WORDS`` words or
more together, so a repeated passage goes wherever it stands and however it is wrapped, while a chance sentence stays.
A shorter run stays too, unless one of its units is boilerplate: it stands in ``BOILERPLATE`` of all documents.  The cut spans are kept as offsets into the original text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import by_sorting, digest, staged

RUN_WORDS = 20          # fewest words of a run of repeated units that is cut
BOILERPLATE = 0.2       # share of the documents from which a unit is cut even alone
SPANS = "array<struct<start:bigint,length:bigint,line:int>>"
WORD_GAP = r"[^\p{L}\p{N}]+"
UNIT_END = r"\n|(?<=[.!?]) "        # one character between two units, in Java's and Python's patterns alike
HOT = 1000              # at most so many digests are joined by broadcast: those with over a thousandth of all units


def _normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), WORD_GAP, " "))


def _units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copy, at, words, unit): the digests of the units that hold a word."""
    unit = F.posexplode(F.split(text, UNIT_END)).alias("at", "_raw")
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_copy"), unit)
    rows = rows.withColumn("_unit", _normal(F.col("_raw"))).filter("_unit != ''")
    return rows.select("_key", "_copy", "at", (F.length("_unit") - F.length(F.translate("_unit", " ", "")) + 1).alias("words"), F.substring(digest(F.col("_unit")), 1, 16).alias("unit"))


def _common(rows: DataFrame, least: float) -> DataFrame:
    """(unit, common): whether ``least`` documents or more hold each unit of the rows."""
    documents = rows.select("unit", "_key", "_copy").distinct().groupBy("unit").agg(F.count("*").alias("docs"))
    return documents.select("unit", (F.col("docs") >= least).alias("common"))


def _later(units: DataFrame, least: float) -> DataFrame:
    """(key, copy, at, words, common): the units that an earlier one equals; common ones stand in ``least`` documents or more.

    The few digests that make up a thousandth of the units each meet their rows by broadcast, so no task gets all rows of one digest.
    """
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("k"), F.col("_copy").alias("c"), F.col("at").alias("l"))
    repeated = staged(units.groupBy("unit").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1"), "line-repeated")
    many = max(HOT, units.count() / HOT)
    hot, rest = F.broadcast(repeated.filter(F.col("n") > many).select("unit", "first")), repeated.filter(F.col("n") <= many)
    hot_rows = units.join(hot, "unit")
    hot_rows = hot_rows.join(F.broadcast(_common(hot_rows, least)), "unit")
    usual = units.join(hot, "unit", "left_anti").join(by_sorting(rest.select("unit", "first")), "unit")
    if many >= least:       # otherwise no unit below the hot ones can be common
        asked = units.join(rest.filter(F.col("n") >= least).select("unit"), "unit")
        usual = usual.join(_common(asked, least), "unit", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    else:
        usual = usual.withColumn("common", F.lit(False))
    return hot_rows.unionByName(usual).filter(rank != F.col("first")).select("_key", "_copy", "at", "words", "common")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, boilerplate: float = BOILERPLATE) -> DataFrame:
    """The documents with repeated passages removed, plus ``removed``: array of (start, length, line) in the original, one for each run.

    ``start`` and ``length`` count code points and ``line`` is the line where the run begins; a cut takes its units with the separator after each (the one
    before for the text's last unit), so the rest of the text stands as it was.  Units without a word (blank lines, rules) do not part a run and stay.
    The first occurrence by key, then by place, stays; a null key ranks last, and rows that agree in key and text share one rank, so that a repeated
    row loses only what an earlier rank holds.  Null texts stay null; an empty text has no units.  All columns of the input remain; a
    column named ``removed`` is replaced.  ``run_words=1`` cuts every repeated unit.

    Units are reduced to one row a digest and task before the shuffle.  Texts are shuffled once, by key, to meet their cuts.
    """
    units = staged(_units(docs, key, text), "line-units")
    cuts = _later(units, max(2.0, boilerplate * docs.count())).groupBy("_key", "_copy").agg(F.collect_set(F.struct("at", "words", "common")).alias("_cut"), F.sum("words").alias("_w"), F.max("common").alias("_c"))
    cuts = cuts.filter((F.col("_w") >= run_words) | F.col("_c")).select("_key", "_copy", "_cut")
    # the row travels as one struct, so no column of the input can clash with a helper
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("c"))
    met = rows.join(cuts, rows["k"].eqNullSafe(cuts["_key"]) & (rows["c"] == cuts["_copy"]), "left").select("row", "_cut")
    cut = F.pandas_udf(_cutting(run_words), f"text string, removed {SPANS}")
    out = met.withColumn("_out", cut(F.when(F.col("_cut").isNotNull(), F.col("row")[text]), "_cut"))
    return out.select(*[F.coalesce("_out.text", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"],
                      F.coalesce("_out.removed", F.array().cast(SPANS)).alias("removed"))


def _runs(text: str, later: dict[int, tuple[int, bool]], run_words: int) -> list[list[tuple[int, int, int]]]:
    """The runs to cut, each a list of (start, end, line) of its units."""
    ends, word = re.compile(UNIT_END), re.compile(r"[^\W_]")
    runs, run, words, common, start, line = [], [], 0, False, 0, 0
    for i, m in enumerate([*ends.finditer(text), None]):
        end = m.start() if m else len(text)
        if i in later:
            run.append((start, end, line))
            words, common = words + later[i][0], common or later[i][1]
        elif word.search(text, start, end):
            if run and (words >= run_words or common):
                runs.append(run)
            run, words, common = [], 0, False
        if m:
            line += m.group() == "\n"
            start = m.end()
    return [*runs, run] if run and (words >= run_words or common) else runs


def _cutting(run_words: int):
    def without(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        """Texts without the runs, and where those stood; both null where nothing is cut."""
        kept, removed = [], []
        for text, cut in zip(texts, cuts):
            if text is None:
                kept.append(None)
                removed.append(None)
                continue
            runs = _runs(text, {c["at"]: (c["words"], c["common"]) for c in cut}, run_words)
            at, pieces = 0, []
            for start, end, _ in (u for run in runs for u in run):
                pieces.append(text[at:start])
                at = end + 1
            left = "".join(pieces) + text[at:]
            if at > len(text) and left:
                left = left[:-1]        # the last unit went: the separator before it goes too
            kept.append(left if runs else text)
            removed.append([{"start": r[0][0], "length": r[-1][1] - r[0][0], "line": r[0][2]} for r in runs])
        return pd.DataFrame({"text": kept, "removed": removed})
    return without

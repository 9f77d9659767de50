"""Quality rules: text statistics and decision lists learned by sequential covering.

Everything on the path is DataFrame code.  A document's statistics are computed inside
its row, so no key can be hot.  The learner never sees rows: each step asks Spark for
the label counts per (statistic, bin) under the conditions found so far, a table of at
most statistics x bins rows, whatever the number of labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import by_sorting, staged, total

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5

#: What rules may test, as expressions over the columns of :func:`document_statistics`.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / greatest(n_words, 1L)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1L)",
    "marks_per_word": "n_marks / greatest(n_words, 1L)",
    "upper_share": "n_upper / greatest(word_chars, 1L)",
    "digit_share": "n_digits / greatest(word_chars, 1L)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1L)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
}


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: key, the row itself as the struct ``_row`` if ``whole``, and the counts below, all long.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_marks (``!?=_~^``), n_upper, n_digits,
    n_lines (lines with a word), n_dup_lines (such lines equal to an earlier one), n_repeat_words
    (words covered by a five-word window that the text holds twice or more).

    Words are runs of characters other than ASCII white space.  A null text counts as empty and
    gives zeros; repeated rows give repeated rows; null keys stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<string>")
    rows = docs.select(F.col(key).alias("_key"), *[F.struct("*").alias("_row")] * whole, t.alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    rows = rows.select(
        "*",
        F.when(trimmed == "", empty).otherwise(F.split(trimmed, SPACE_RUN)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(NON_SPACE)).alias("_lines"),
    )
    without = lambda chars: F.length("_text") - F.length(F.regexp_replace("_text", chars, ""))
    rows = rows.select(
        "_key", *["_row"] * whole,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        without("[!?=_~^]+").cast("long").alias("n_marks"),
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        without(r"[0-9]+").cast("long").alias("n_digits"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = F.transform("_hashes", lambda x, i: F.xxhash64(x, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]))
    rows = rows.withColumn("_windows", F.slice(window, F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))).drop("_hashes")
    # only texts with a repeated window pay for the sort
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs)).drop("_windows")
    same = lambda p, i, step: F.coalesce(F.get(F.col("_pairs"), i + step)["h"] == p["h"], F.lit(False))
    again = F.filter("_pairs", lambda p, i: same(p, i, -1) | same(p, i, 1))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("_pairs")
    gap = F.transform("_starts", lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("_starts"), i + 1) - p), F.lit(WINDOW)).cast("long"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(total(gap), F.lit(0).cast("long"))).drop("_starts")
    return rows.withColumnRenamed("_key", key)


def base_failed() -> Column:
    """The fixed rule: under ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


class DecisionList:
    """Ordered rules; a document that one of them covers is rejected."""

    def __init__(self, rules: list[list[Condition]]):
        self.rules = rules

    def verdict(self) -> Column:
        """Text of the first rule that covers the row, else null."""
        out = None
        for rule in self.rules:
            hit, text = _all(c.column() for c in rule), F.lit(" AND ".join(map(str, rule)))
            out = F.when(hit, text) if out is None else out.when(hit, text)
        return out if out is not None else F.lit(None).cast("string")


def _all(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def learn_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bins: int = 40, max_rules: int = 6,
                max_conditions: int = 3, min_precision: float = 0.95, min_share: float = 0.005) -> DecisionList:
    """Sequential covering over labelled statistics; ``label`` 0 marks what rules should cover.

    Documents that the fixed rule rejects teach nothing.  Two thirds of the other labelled documents (by a
    hash of the key) grow a rule, one condition at a time; the rest prune it to the prefix with the best precision.  A rule is taken
    while its precision on the pruning documents is at least ``min_precision`` and it covers at least
    ``min_share`` of their bad ones; the documents it covers then leave both parts.

    A document labelled twice counts once, as good when in doubt.  Null labels and keys without a
    document teach nothing; without labels the list is empty and rejects nothing.
    """
    votes = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_good"))
    known = stats.filter(~base_failed()).dropDuplicates([key]).join(by_sorting(votes), key).select(
        *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()], (F.col("_good") == 0).cast("int").alias("_bad"),
        (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("_prune"))
    known = staged(known, "quality-labelled")
    steps = F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])
    # good and bad documents have cut points of their own, else those of a rare class are missed
    found = known.groupBy("_bad").agg(*[F.percentile_approx(f, steps, F.lit(2000)).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({x for r in found for x in (r[f] or [])}) for f in FEATURES}
    if not found:
        return DecisionList([])
    # bin b of a statistic: values above b of its cuts
    table = staged(known.select("_bad", "_prune", *[_bin(f, cuts[f]).alias(f) for f in FEATURES]), "quality-bins")
    rules: list[list[Condition]] = []
    taken: list[list[tuple[str, bool, int]]] = []
    for _ in range(max_rules):
        left = table.filter(_all(~_binned(r) for r in taken))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            best = _best_condition(_counts(left.filter(~F.col("_prune") & _binned(rule))), cuts, min_precision)
            if best is None:
                break
            rule.append(best)
        rule = _pruned(left.filter("_prune"), rule, min_precision, min_share)
        if not rule:
            break
        taken.append(rule)
        rules.append([Condition(f, above, _threshold(cuts[f], above, i)) for f, above, i in rule])
    return DecisionList(rules)


def _bin(feature: str, cuts: list[float]) -> Column:
    levels = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(levels, lambda c: F.col(feature) > c))


def _threshold(cuts: list[float], above: bool, i: int) -> float:
    """A lower limit moves half way to the next cut: nothing was seen between the two, and doubt favours the document."""
    return (cuts[i] + cuts[i + 1]) / 2 if above and i + 1 < len(cuts) else cuts[i]


def _binned(rule) -> Column:
    return _all(F.col(f) > i if above else F.col(f) <= i for f, above, i in rule)


def _counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("c")
    found = rows.select(cells, "_bad").groupBy("c.f", "c.b").agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in found:
        out.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    return out


def _best_condition(counts, cuts, min_precision: float):
    """The (statistic, above, cut) to add, None when nothing gains.

    Of the conditions that reach the precision by themselves the one that covers the most bad
    documents; when there is none, the one with the largest information gain.
    """
    if not counts:
        return None
    some = next(iter(counts.values()))
    p0, n0 = sum(p for p, _ in some.values()), sum(n for _, n in some.values())
    if not p0 or not n0:
        return None
    base, best, most = math.log2(p0 / (p0 + n0)), None, (False, 1e-9)
    for f in FEATURES:
        p = n = 0
        for i in range(len(cuts[f])):
            dp, dn = counts[f].get(i, (0, 0))
            p, n = p + dp, n + dn
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = a * (math.log2(a / (a + b)) - base) if a else 0.0
                pure = gain > 1e-9 and a >= min_precision * (a + b)
                if (score := (pure, a if pure else gain)) > most:
                    best, most = (f, above, i), score
    return best


def _pruned(rows: DataFrame, rule, min_precision: float, min_share: float):
    """The prefix of the rule with the best precision on the pruning rows, [] when none is good enough."""
    if not rule:
        return []
    heads = [rule[: k + 1] for k in range(len(rule))]
    counts = rows.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("all"),
                      *[F.coalesce(F.sum(F.when(_binned(h), F.col("_bad"))), F.lit(0)).alias(f"p{k}") for k, h in enumerate(heads)],
                      *[F.coalesce(F.sum(F.when(_binned(h), 1 - F.col("_bad"))), F.lit(0)).alias(f"n{k}") for k, h in enumerate(heads)]).first()
    scored = [((counts[f"p{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"]), -k) for k in range(len(heads))]
    precision, k = max(scored)
    k = -k
    enough = counts[f"p{k}"] >= max(1, min_share * counts["all"])
    return heads[k] if precision >= min_precision and enough else []


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **learner) -> DataFrame:
    """Statistics of every document with base_failed, rule (the learned rule that covers it) and kept."""
    stats = staged(document_statistics(docs, key, text), "quality-stats")
    rules = learn_rules(stats, labels, key, **learner)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **learner) -> DataFrame:
    """The documents that pass, with their own columns.  One text scan: the columns ride along with the statistics."""
    stats = staged(document_statistics(docs, key, text, whole=True), "quality-stats")
    rules = learn_rules(stats.drop("_row"), labels, key, **learner)
    return stats.filter(~base_failed() & rules.verdict().isNull()).select("_row.*")

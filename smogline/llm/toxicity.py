"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled texts, distinct and without near copies.  Terms are words and word beginnings that tell the labels apart beyond chance
(chi-square over the examples, corrected for the number of words tried, and an odds ratio of 3 either way); a text's vector holds
its counts of these terms, weighted by TF-IDF.  Examples with equal vectors are one entry with summed label weights.

Entries lie in blocks of 64, neighbours sharing their strongest terms.  The index has for each term the blocks where it stands
with its largest weight there.  A query adds these up to a bound for every block, takes blocks from the largest bound down, scores their
entries exactly and stops when no further block can reach its k-th best.

The k nearest vote with squared cosine; isotonic regression over leave-one-out votes of the examples turns votes into rates.  Nothing but
the text is an input of a score, so equal texts have equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from smogline.llm.common import Remembered, staged

EXAMPLES = 6_000        # most examples of either label; the documented bound of the sample
TERMS = 4_096           # most terms
SUPPORT = 3             # fewest examples with a term
ODDS = 3.0              # least odds ratio, up or down
CHANCE = 0.05           # chance of any false term among all words tried
BLOCK = 64
NEAREST = 25
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)       # letters of the word beginnings that are terms too, for words with endings
HEAD = 3
_LONG = 1 << 20


def _words(text: str | None):
    low = (text or "").lower()
    return WORD.findall(low) if len(low) < _LONG else (m.group() for m in WORD.finditer(low))


def _terms(word: str) -> list[str]:
    """The word and its stems: its first letters, with a mark that tells them from a word."""
    return [word, *[word[:n] + "-" for n in STEMS if n < len(word)]]


def _term_counts(text: str | None, among: dict[str, int], heads: set[str]) -> Counter:
    """How often the known terms stand in a text; ``heads`` are their first letters."""
    counts = Counter()
    for word, n in Counter(_words(text)).items():
        if word[:HEAD] in heads:
            for term in _terms(word):
                if term in among:
                    counts[term] += n
    return counts


def _shapes(batches):
    """Terms of a text and the four least hashes of its five-word runs, by which near copies are told."""
    for batch in batches:
        keys, rates, texts = (c.to_pylist() for c in batch.columns)
        terms, marks = [], []
        for text in texts:
            words = list(_words(text))
            terms.append(sorted({t for w in set(words) for t in _terms(w)}))
            runs = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i: i + 5])) for i in range(max(1, len(words) - 4))), dtype=np.uint64)
            marks.append([int((runs * np.uint64(m)).min().view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))], names=["digest", "rate", "terms", "marks"])


def examples_of(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = EXAMPLES) -> tuple[DataFrame, dict[bool, float]]:
    """(digest, doc_id, rate, _text) for at most ``most`` distinct texts of either label, by least hash, and how many texts each stands for.

    Rows without key or label teach nothing; several labels of a document count as positive if one is, and a text with several documents has their mean.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("double")).alias("_y"))
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("digest"))
    known = staged(rows.join(marked, "_id").groupBy("digest").agg(F.min("_id").alias("doc_id"), F.avg("_y").alias("rate")), "toxicity-known")
    sides = known.groupBy((F.col("rate") > 0).alias("side")).agg(F.count("*").alias("n")).collect()
    taken = [known.filter((F.col("rate") > 0) == s).orderBy(F.xxhash64("digest"), "digest").limit(most) for s in (True, False)]
    chosen = staged(taken[0].unionByName(taken[1]), "toxicity-chosen")
    found = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("_text")).join(F.broadcast(chosen), ["doc_id", "digest"])   # at most 2 * most rows of three numbers
    texts = staged(found.groupBy("digest").agg(F.min_by(F.struct("doc_id", "rate", "_text"), "doc_id").alias("r")).select("digest", "r.*"), "toxicity-texts")
    return texts, {r["side"]: max(1.0, r["n"] / most) for r in sides}


def _without_near_copies(shapes: DataFrame) -> DataFrame:
    """Examples of which no earlier one of the same label shares a mark; the marks of the bounded sample meet on the driver."""
    seen, kept = set(), []
    for r in shapes.select("digest", (F.col("rate") > 0).alias("side"), "marks").orderBy("digest").collect():
        marks = {(r["side"], i, m) for i, m in enumerate(r["marks"])}
        if seen.isdisjoint(marks):
            kept.append((r["digest"],))
        seen |= marks
    return shapes.join(F.broadcast(shapes.sparkSession.createDataFrame(kept, "digest bigint")), "digest")


def telling_terms(shapes: DataFrame, most: int = TERMS) -> dict[str, int]:
    """The terms that tell the labels apart, with the number of examples that hold them."""
    n = shapes.agg(F.sum("rate").alias("p"), F.sum(1 - F.col("rate")).alias("q")).first()
    p, q = float(n["p"] or 0), float(n["q"] or 0)
    if not p or not q:
        return {}
    counts = shapes.select("rate", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("rate").alias("a"), F.sum(1 - F.col("rate")).alias("b"), F.count("*").alias("n"))
    counts = staged(counts, "toxicity-terms")
    tried = counts.filter(F.col("n") >= SUPPORT).count()
    limit = NormalDist().inv_cdf(1 - CHANCE / max(1, tried) / 2) ** 2
    a, b = F.col("a"), F.col("b")
    odds = ((a + 0.5) * (q - b + 0.5)) / ((b + 0.5) * (p - a + 0.5))
    square = (p + q) * F.pow(a * (q - b) - b * (p - a), 2) / (p * q * (a + b) * (p + q - a - b + 1e-9))
    good = counts.filter((F.col("n") >= SUPPORT) & (square >= limit) & ((odds >= ODDS) | (odds <= 1 / ODDS))).orderBy(square.desc(), "term").limit(most)
    return {r["term"]: r["n"] for r in good.collect()}


class BlockMaxIndex:
    """Entries (sparse unit vectors) in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.order = sorted(range(len(vectors)), key=lambda i: (sorted(((-w, t) for t, w in vectors[i].items()))[:3], i))
        self.blocks, postings = [], {}
        for b, at in enumerate(range(0, len(self.order), block)):
            members = self.order[at: at + block]
            terms = sorted({t for i in members for t in vectors[i]})
            place = {t: j for j, t in enumerate(terms)}
            weights = np.zeros((len(terms), len(members)))
            for j, i in enumerate(members):
                for t, w in vectors[i].items():
                    weights[place[t], j] = w
            self.blocks.append((place, weights, np.array(members)))
            for t, w in zip(terms, weights.max(axis=1).tolist()):
                postings.setdefault(t, []).append((b, w))
        self.postings = {t: (np.array([b for b, _ in p]), np.array([w for _, w in p])) for t, p in postings.items()}

    def bounds(self, query: dict[int, float]) -> np.ndarray:
        bound = np.zeros(len(self.blocks))
        for t, w in query.items():
            if t in self.postings:
                where, most = self.postings[t]
                bound[where] += w * most
        return bound

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k entries of largest positive cosine as (cosine, entry), ties by entry; ``skip`` is left out."""
        bound, found, scored = self.bounds(query), [], 0
        for b in np.argsort(-bound, kind="stable").tolist():
            # a hair below, so that rounding in the bound never hides an entry
            if bound[b] <= 0 or (len(found) >= k and bound[b] < found[k - 1][0] - 1e-9):
                break
            place, weights, members = self.blocks[b]
            scores = np.zeros(len(members))
            for t, w in sorted(query.items()):
                if t in place:
                    scores += w * weights[place[t]]
            found += [(s, i) for s, i in zip(np.round(scores, 12).tolist(), members.tolist()) if s > 0 and i != skip]
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[k:]
            scored += 1
        self.scored = scored
        return found


def _unit(counts, number: dict[str, int], idf: list[float]) -> dict[int, float]:
    weights = {number[w]: (1 + math.log(n)) * idf[number[w]] for w, n in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / length for t, w in sorted(weights.items())}


def _vote(near: list[tuple[float, int]], positive, negative, less: tuple[int, float, float] = (-1, 0.0, 0.0)) -> float | None:
    """Share of the positive weight among the nearest, by squared cosine; ``less`` takes an example's own weight from its entry."""
    up = down = 0.0
    for s, i in near:
        own = less[1:] if i == less[0] else (0.0, 0.0)
        up += s * s * (positive[i] - own[0])
        down += s * s * (negative[i] - own[1])
    return up / (up + down) if up + down > 1e-12 else None


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Rates that rise with the vote, from (vote, label rate, weight): the mean vote and rate of each pooled block."""
    pooled: list[list[float]] = []
    for x, y, w in sorted(points):
        pooled.append([x * w, y * w, w])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
    return [x / w for x, _, w in pooled], [y / w for _, y, w in pooled]


class Scorer:
    """Everything a task needs to score texts; its size is bounded by the number of examples and terms."""

    def __init__(self, terms: dict[str, int], n: int):
        self.number = {t: i for i, t in enumerate(sorted(terms))}
        self.heads = {t.removesuffix("-")[:HEAD] for t in terms}
        self.idf = [math.log((1 + n) / (1 + terms[t])) + 1 for t in sorted(terms)]
        self.empty_rate, self.votes, self.rates = 0.0, [0.0], [0.0]

    def fill(self, rows: list[tuple[int, float, dict[str, int]]], stands_for: dict[bool, float]) -> None:
        """Entries from (doc_id, rate, counts) of the examples with a term."""
        entries: dict[tuple, list] = {}
        for doc, rate, counts in sorted(rows, key=lambda r: r[0]):
            weight = stands_for.get(rate > 0, 1.0)
            e = entries.setdefault(tuple(sorted(counts.items())), [0.0, 0.0, doc])
            e[0] += weight * rate
            e[1] += weight * (1 - rate)
        self.entry = {k: i for i, k in enumerate(entries)}
        self.positive, self.negative, self.docs = (list(x) for x in zip(*entries.values())) if entries else ([], [], [])
        self.index = BlockMaxIndex([_unit(dict(k), self.number, self.idf) for k in entries])

    def left_out(self, rate: float, counts: dict[str, int], weight: float) -> float | None:
        """The vote on an example by the others."""
        own = self.entry[tuple(sorted(counts.items()))]
        alone = self.positive[own] + self.negative[own] <= weight * (1 + 1e-9)
        near = self.index.nearest(_unit(counts, self.number, self.idf), NEAREST, skip=own if alone else -1)
        return _vote(near, self.positive, self.negative, (own, weight * rate, weight * (1 - rate)))

    def score(self, counts: Counter) -> tuple[float, list]:
        if not counts:
            return self.empty_rate, []
        near = self.index.nearest(_unit(counts, self.number, self.idf), NEAREST)
        vote = _vote(near, self.positive, self.negative)
        rate = self.empty_rate if vote is None else float(np.interp(vote, self.votes, self.rates))
        return min(1.0, max(0.0, rate)), [(self.docs[i], s, self.positive[i] / (self.positive[i] + self.negative[i])) for s, i in near[:3]]


def _example_counts(number, heads):
    def run(batches):
        for batch in batches:
            keys, rates, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rates), pa.array([list(_term_counts(t, number, heads).items()) for t in texts], pa.map_(pa.string(), pa.int64()))], names=["doc_id", "rate", "counts"])
    return run


def _left_out_votes(scorer: Scorer, stands_for: dict[bool, float]):
    def run(batches):
        for batch in batches:
            rates, counts = batch.column("rate").to_pylist(), batch.column("counts").to_pylist()
            votes = [scorer.left_out(r, dict(c), stands_for.get(r > 0, 1.0)) if c else None for r, c in zip(rates, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("rate"), pa.array(votes, pa.float64()), pa.array([bool(c) for c in counts])], names=["rate", "vote", "termed"])
    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = EXAMPLES) -> Scorer:
    """The scorer of all rows of ``docs`` that ``labels`` marks, from at most ``most`` examples of either label.

    Without positive or negative examples there are no terms and every text gets the overall rate (0 without any label).
    """
    texts, stands_for = examples_of(docs, labels, label, key, text, most)
    shapes = staged(texts.select("digest", "rate", "_text").mapInArrow(_shapes, "digest bigint, rate double, terms array<string>, marks array<bigint>"), "toxicity-shapes")
    shapes = staged(_without_near_copies(shapes), "toxicity-examples")
    terms = telling_terms(shapes)
    scorer = Scorer(terms, shapes.count())
    counted = texts.join(shapes.select("digest"), "digest", "left_semi").select(F.col("doc_id").cast("long"), "rate", "_text")
    counted = staged(counted.mapInArrow(_example_counts(scorer.number, scorer.heads), "doc_id bigint, rate double, counts map<string,bigint>"), "toxicity-counts")
    scorer.fill([(r["doc_id"], r["rate"], dict(r["counts"])) for r in counted.filter(F.size("counts") > 0).collect()], stands_for)
    votes = counted.mapInArrow(_left_out_votes(scorer, stands_for), "rate double, vote double, termed boolean").collect()
    weigh = lambda r: stands_for.get(r["rate"] > 0, 1.0)
    silent = [r for r in votes if not r["termed"]] or votes
    scorer.empty_rate = sum(r["rate"] * weigh(r) for r in silent) / sum(map(weigh, silent)) if silent else 0.0
    if points := [(r["vote"], r["rate"], weigh(r)) for r in votes if r["vote"] is not None]:
        scorer.votes, scorer.rates = isotonic(points)
    return scorer


def _scored(scorer: Scorer):
    def run(batches):
        known = Remembered(50_000)
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                counts = _term_counts(text, scorer.number, scorer.heads)
                sign = tuple(sorted(counts.items()))
                if known.missing({sign}):
                    known.young[sign] = scorer.score(counts)
                found.append((*known.young[sign], [w for w, _ in sign]))
            scores, near, words = zip(*found) if found else ((), (), ())
            arrays = [pa.array(scores, pa.float64()), pa.array([[{"doc_id": d, "cosine": s, "toxic": r} for d, s, r in n] for n in near], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))),
                      pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "score", "nearest", "terms"])
    return run


def score_texts(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), nearest (the three nearest examples: doc_id, cosine, rate of their label) and terms (the telling words found) for every row.

    Null and empty texts, and those without a telling word, get the rate of examples without one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(scorer), f"doc_id {kind}, score double, nearest array<struct<doc_id:bigint,cosine:double,toxic:double>>, terms array<string>")


def held_out(key: Column) -> Column:
    """Whether a document is kept for testing: the unsigned CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def judge_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3 on), nearest and terms; learned from the labelled rows that are not held out."""
    scorer = learn(docs.filter(~held_out(F.col(key))), labels, key=key, text=text)
    return score_texts(docs, scorer, key, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest", "terms")

"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The index holds the test items, cut into entries of at most ``ENTRY_WORDS`` words.  Every training passage (64 words, each 32 words
further) is a query; an entry is retrieved when its BM25 score reaches ``RETRIEVE`` of the score that the entry gives itself, so one
threshold fits long and short entries.  Three bounds are tested for all passages of a batch at once: the sum of the
terms' largest weights (the WAND bound: passages below it are skipped), the sum of their largest weights within each
block of entries (block-max: blocks below it are skipped), and the score itself.  A retrieved item is
verified against the words around the passage: question and answer must both stand there.

Indexing covers all items; texts are read once per ``PASS_ITEMS`` items and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from smogline.llm.common import per_process

WORD = re.compile(r"\w+")
STRIDE = 32             # a passage is two strides long
ENTRY_WORDS = 32
RETRIEVE = 0.4
BLOCK = 8               # entries per block of the index
SHARD_ITEMS = 1024      # items per index
PASS_ITEMS = 32_768     # items that are shipped to the tasks at once
SHINGLE = 5
SIMILAR = 0.8
K1, B = 1.2, 0.75
HITS = "array<struct<item:{kind},score:double,question:double,answer:double,start:bigint,words:bigint>>"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; marks and symbols between them do not count."""
    return WORD.findall(text.lower().replace("_", " ")) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence answers what stands before it; a single sentence has no answer."""
    ends = [m.end() for m in re.finditer(r"[.?!:]\s+(?=\S)|\n+(?=\S)", text.rstrip())]
    for at in reversed(ends):
        head, tail = words_of(text[:at]), words_of(text[at:])
        if head and tail:
            return head, tail
    return words_of(text), []


def entries_of(words: list[str]) -> list[list[str]]:
    """The entries of an item's words; a rest shorter than half an entry joins the one before it."""
    parts = [words[a: a + ENTRY_WORDS] for a in range(0, len(words), ENTRY_WORDS)]
    if len(parts) > 1 and len(parts[-1]) < ENTRY_WORDS // 2:
        last = parts.pop()
        parts[-1] = parts[-1] + last
    return parts


class Statistics:
    """What BM25 needs to know of all entries of all items: their number, mean length and how many hold each term."""

    def __init__(self):
        self.n, self.words, self.frequency = 0, 0, Counter()

    def add(self, items: list[tuple]) -> "Statistics":
        for _, text in items:
            question, answer = question_and_answer(text or "")
            for entry in entries_of(question + answer):
                self.n += 1
                self.words += len(entry)
                self.frequency.update(set(entry))
        return self

    def weights(self, counts: Counter) -> dict[str, float]:
        """BM25 weights of an entry's terms."""
        mean, length = self.words / max(1, self.n), sum(counts.values())
        return {t: math.log(1 + (self.n - self.frequency[t] + 0.5) / (self.frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in counts.items()}


class Index:
    """Entries of some items with normalised BM25 weights, by term and by block.  The statistics are those of all items, so an entry's weights do not depend
    on what else its index holds."""

    def __init__(self, items: list[tuple], statistics: Statistics):
        self.items = [(key, *question_and_answer(text or "")) for key, text in items]
        entries = [(i, words) for i, (_, q, a) in enumerate(self.items) for words in entries_of(q + a)]
        self.owner = [i for i, _ in entries]
        counts = [Counter(w) for _, w in entries]
        n = len(entries)
        self.terms = {t: k for k, t in enumerate(sorted(set(chain.from_iterable(counts))))}
        blocks = max(1, -(-n // BLOCK))
        self.block_max = np.zeros((len(self.terms), blocks), dtype=np.float32)
        self.postings: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in self.terms]
        for e, c in enumerate(counts):
            weights = statistics.weights(c)
            own = sum(weights.values())
            for t, w in weights.items():
                k = self.terms[t]
                self.postings[k][e // BLOCK].append((e, w / own))
                self.block_max[k, e // BLOCK] = max(self.block_max[k, e // BLOCK], w / own * (1 + 1e-6))
        self.term_max = self.block_max.max(axis=1).astype(np.float64) if len(self.terms) else np.zeros(0)

    def retrieve(self, texts: list[list[str]]):
        """(text, item, score, first word of the passage) of every passage and item above the threshold."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = np.fromiter(map(self.terms.get, chain.from_iterable(texts), repeat(-1)), dtype=np.int32, count=int(sizes.sum()))
        units = np.maximum(1, -(-sizes // STRIDE))
        first_unit = np.concatenate(([0], np.cumsum(units)))
        position = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        unit = np.repeat(first_unit[:-1], sizes) + position // STRIDE
        known = ids >= 0
        term, unit = ids[known].astype(np.int64), unit[known]
        count = int(first_unit[-1])
        last = np.zeros(count + 1, dtype=bool)
        last[first_unit[1:] - 1] = True
        bound = np.bincount(unit, weights=self.term_max[term], minlength=count + 1)
        both = bound + np.where(last, 0.0, np.concatenate((bound[1:], [0.0])))
        alive = both >= RETRIEVE
        # passage u holds strides u and u + 1
        second = np.flatnonzero((unit > 0) & ~last[unit - 1])
        passage, term = np.concatenate((unit, unit[second] - 1)), np.concatenate((term, term[second]))
        chosen = alive[passage]
        if not chosen.any():
            return
        key = np.unique(passage[chosen] * len(self.terms) + term[chosen])
        passage, term = key // len(self.terms), key % len(self.terms)
        heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        tails = np.append(heads[1:], len(passage))
        step = max(1, 4_000_000 // self.block_max.shape[1])        # rows of the block sums held at once
        at = 0
        while at < len(heads):
            to = max(at + 1, int(np.searchsorted(tails, heads[at] + step, side="right")))
            rows = slice(heads[at], tails[to - 1])
            sums = np.add.reduceat(self.block_max[term[rows]], heads[at:to] - heads[at], axis=0)
            for h, block in zip(*(x.tolist() for x in np.nonzero(sums >= RETRIEVE))):
                h += at
                scores: dict[int, float] = defaultdict(float)
                for t in term[heads[h]:tails[h]].tolist():
                    for e, w in self.postings[t].get(block, ()):
                        scores[e] += w
                for e, score in scores.items():
                    if score >= RETRIEVE:
                        u = int(passage[heads[h]])
                        text = int(np.searchsorted(first_unit, u, side="right")) - 1
                        yield text, self.owner[e], score, (u - int(first_unit[text])) * STRIDE
            at = to

    def verify(self, words: list[str], item: int, start: int) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles around the passage, None when that is no leak."""
        _, question, answer = self.items[item]
        reach = len(question) + len(answer)
        region = words[max(0, start - reach): start + 2 * STRIDE + reach]
        found = _shingles(region)
        q, a = _share(question, found, region), _share(answer, found, region)
        return (q, a) if q >= SIMILAR and a >= SIMILAR else None


def _shingles(words: list[str]) -> set:
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def _share(words: list[str], found: set, region: list[str]) -> float:
    """Share of the words' distinct shingles that were found; fewer words must stand there one after the other."""
    if not words:
        return 1.0
    if len(words) < SHINGLE:
        n = len(words)
        return float(any(region[i: i + n] == words for i in range(len(region) - n + 1)))
    own = _shingles(words)
    return len(own & found) / len(own)


def _scanner(items: list[tuple], statistics: Statistics):
    token = uuid.uuid4().hex

    def run(batches):
        kept = per_process(("decontam",), dict)      # the indexes of the pass in work, built once a worker
        if kept.get("token") != token:
            kept.update(token=token, indexes=[Index(items[a: a + SHARD_ITEMS], statistics) for a in range(0, len(items), SHARD_ITEMS)])
        indexes = kept["indexes"]
        for batch in batches:
            texts = [words_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            best: list[dict] = [{} for _ in texts]
            for k, index in enumerate(indexes):
                checked = set()
                for text, item, score, start in index.retrieve(texts):
                    if (text, item, start) in checked or best[text].get((k, item), {"score": -1.0})["score"] >= score:
                        continue
                    checked.add((text, item, start))
                    if shares := index.verify(texts[text], item, start):
                        best[text][k, item] = {"item": index.items[item][0], "score": min(1.0, score), "question": shares[0], "answer": shares[1],
                                               "start": start, "words": 2 * STRIDE}
            rows = [[b[k] for k in sorted(b)] for b in best]
            yield batch.set_column(batch.num_columns - 1, "hits", pa.array(rows, _hit_type(items)))
    return run


def _hit_type(items):
    key = pa.string() if items and isinstance(items[0][0], str) else pa.int64()
    return pa.list_(pa.struct([("item", key), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))


def _passes(benchmark: DataFrame, item: str, text: str):
    """The items, at most PASS_ITEMS at a time; items without a word can leak nowhere."""
    rows = benchmark.filter(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    rows = rows.withColumn("item", F.col("item").cast("string" if dict(rows.dtypes)["item"] == "string" else "long"))
    passes = max(1, -(-2 * rows.count() // PASS_ITEMS)) if rows.count() > PASS_ITEMS else 1
    for k in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        found = [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect() if words_of(r["text"])]
        if found:
            yield found


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with ``hits``: array of (item, score, question, answer, start, words), one per leaked item, empty when clean.

    ``score`` is the best passage's share of the entry's own BM25 score, ``question`` and ``answer`` the shares of their five-word shingles
    that stand around it, ``start`` the passage's first word.  A leak needs both shares at 0.8 or more; an item of one
    sentence has no answer to look for.  Null and empty texts and an empty benchmark give no hits; two items with one text are both reported; rows are
    neither dropped nor merged and keep all their columns (a column named ``hits`` is replaced).
    """
    kind = "string" if dict(benchmark.dtypes)[item] == "string" else "bigint"
    hits = HITS.format(kind=kind)
    out = docs.drop("hits").withColumn("hits", F.array().cast(hits))
    statistics = Statistics()
    for found in _passes(benchmark, item, item_text):
        statistics.add(found)
    for found in _passes(benchmark, item, item_text):
        terms = {w for _, text in found for w in words_of(text)}
        shipped = Statistics()
        shipped.n, shipped.words, shipped.frequency = statistics.n, statistics.words, Counter({t: n for t, n in statistics.frequency.items() if t in terms})
        names = [c for c in out.columns if c != "hits"]
        rows = out.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col("hits").alias("before"), F.col(text).alias("_text"))
        kinds = ", ".join(f"k{i} {out.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
        rows = rows.mapInArrow(_scanner(found, shipped), f"{kinds}, before {hits}, hits {hits}")
        out = rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.concat("before", "hits").alias("hits"))
    return out


def leaked_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """One row per leaked item of a document: doc_id, item_id, score, question, answer, start, words."""
    text = columns.get("text", "text")
    found = find_leaks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias(text)), benchmark, **columns)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.item").alias("item_id"), "h.score", "h.question", "h.answer", "h.start", "h.words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **columns) -> DataFrame:
    """The documents without a leaked item, with their own columns."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = find_leaks(numbered, benchmark, f"c{docs.columns.index(text)}", **columns)
    return found.filter(F.size("hits") == 0).drop("hits").toDF(*docs.columns)

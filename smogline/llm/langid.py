"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the sum
over all ways to cut it into pieces, found by the forward algorithm; a text's is the product over its words.
Training is expectation maximisation: Spark counts the words of each language, every round maps the words
to the expected counts of their pieces and sums these up; what comes to the driver is one number per
language and piece of the vocabulary.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from smogline.llm.common import Remembered, per_process, staged

TRAIN_ROWS = 4_000          # labelled rows that the classifier is fitted on, at most, per language
LONGEST = 64                # letters of a piece of text that is scored at once; longer words are cut there
CACHED_WORDS = 300_000      # words whose scores a worker remembers, twice; the rest is worked out again
WORD = re.compile(r"[^\W\d_]+")


def load_pieces(path: str) -> list[str]:
    """Texts of the pieces of a rank file that are letters only, with a leading space where the piece starts a word."""
    import base64
    pieces = set()
    with open(path, "rb") as lines:
        for line in lines:
            try:
                text = base64.b64decode(line.split()[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if WORD.fullmatch(text.removeprefix(" ")):
                pieces.add(text.lower())
    return sorted(pieces)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, each after the space that marks a word's start, cut after LONGEST letters."""
    out = []
    for w in WORD.findall(text.lower()):
        if not w.isalpha() and not any(map(str.isalpha, w)):
            continue        # superscripts and the like
        if len(w) <= LONGEST:
            out.append(" " + w)
        else:
            out.append(" " + w[:LONGEST])
            out += [w[i: i + LONGEST] for i in range(LONGEST, len(w), LONGEST)]
    return out


class Model:
    """Log probabilities: ``table`` maps a piece to its row of ``probs`` (pieces x languages); ``other`` stands for any single character."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray, other: np.ndarray):
        self.languages, self.probs, self.other = languages, probs, other
        self.table = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        # one row per piece, one for a single character outside the vocabulary, one for what is no piece
        self.rows = np.concatenate((probs, other[None, :], np.zeros((1, len(languages)))))

    def _pieces(self, words: list[str]):
        """Groups of words of one length: their places in ``words``, the (start, length) of every piece they may hold, ascending by
        start, and the number of the piece that each word has there."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            by_length[len(w)].append(at)
        get, none = self.table.get, len(self.table) + 1
        for n, places in by_length.items():
            spans = [(i, m) for i in range(n) for m in range(1, min(self.longest, n - i) + 1)]
            single = np.array([m == 1 for _, m in spans])
            step = max(1, 2_000_000 // max(1, len(spans)))
            for k in range(0, len(places), step):
                part = places[k: k + step]
                found = np.array([get(words[at][i: i + m], none) for at in part for i, m in spans], dtype=np.int32).reshape(len(part), len(spans))
                found[(found == none) & single] = none - 1      # a character that is no piece stands for itself
                yield part, n, spans, found

    def score(self, words: list[str]) -> list[tuple[float, ...]]:
        """Log probability of each word under each language, summed over all segmentations by the forward algorithm."""
        out: list = [None] * len(words)
        for part, n, spans, found in self._pieces(words):
            alpha = np.zeros((n + 1, len(part), len(self.languages)))
            alpha[0] = 1.0
            for k, (i, m) in enumerate(spans):
                alpha[i + m] += alpha[i] * self.rows[found[:, k]]
            with np.errstate(divide="ignore"):
                logs = np.maximum(np.log(alpha[n]), -745.0)
            for at, row in zip(part, logs.tolist()):
                out[at] = tuple(row)
        return out

    def expected(self, words: list[str], language: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece (rows as in ``rows``) by language, over weighted words."""
        counts = np.zeros(self.rows.size)
        k_languages = len(self.languages)
        for part, n, spans, found in self._pieces(words):
            own, amount = language[part], weight[part]
            probs = self.rows[found, own[:, None]]
            alpha, beta = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
            alpha[0] = beta[n] = 1.0
            for k, (i, m) in enumerate(spans):
                alpha[i + m] += alpha[i] * probs[:, k]
            for k in range(len(spans) - 1, -1, -1):
                i, m = spans[k]
                beta[i] += beta[i + m] * probs[:, k]
            share = np.divide(amount, alpha[n], out=np.zeros(len(part)), where=alpha[n] > 0)
            starts, ends = (np.array(x, dtype=np.int64) for x in zip(*((i, i + m) for i, m in spans)))
            uses = share[:, None] * alpha[starts].T * probs * beta[ends].T
            counts += np.bincount((found * k_languages + own[:, None]).ravel(), weights=uses.ravel(), minlength=counts.size)
        return counts.reshape(self.rows.shape)


def _count_words(batches):
    for batch in batches:
        counts: dict = defaultdict(int)
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for w in words_of(text):
                counts[lang, w] += 1
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
                                         schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def _expectations(model: Model):
    def run(batches):
        place = {lang: i for i, lang in enumerate(model.languages)}
        counts = np.zeros(model.rows.shape)
        for batch in batches:
            langs, words, n = (c.to_pylist() for c in batch.columns)
            counts += model.expected(words, np.array([place[x] for x in langs], dtype=np.int64), np.array(n, dtype=float))
        piece, lang = np.nonzero(counts[:-1])
        yield pa.RecordBatch.from_pydict({"lang": [model.languages[x] for x in lang.tolist()], "piece": piece, "n": counts[piece, lang]},
                                         schema=pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())]))
    return run


def least_hash(wanted: int, n: int) -> int:
    """The bound under which ``wanted`` of n evenly spread 63-bit hashes fall; all of them if n is no larger."""
    return 2**63 - 1 if n <= wanted else max(1, 2**63 * wanted // n)


def train(labelled: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", rounds: int = 3, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit the piece probabilities on rows with a text and a language; None when there are none.

    About ``train_rows`` rows of each language are used (all of a smaller one), those whose 63-bit hash of the whole row falls under the
    language's share: copies of one text with different ids are drawn one by one, and a share never rounds to none.  Counting is spread over
    the rows, so a language with most of the rows is not one task.
    """
    drawn = F.shiftrightunsigned(F.xxhash64(*[c for c, kind in labelled.dtypes if "map<" not in kind]), 1)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), drawn.alias("drawn"))
    # the bound as a threshold on the hash: no sort, no shuffle of texts
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for l, n in known.items() for x in (l, least_hash(train_rows, n))]), F.col("lang"))
    rows = rows.filter(F.col("drawn") < share).select("lang", "text")
    words = staged(rows.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    languages = sorted(known)
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1e-4), np.full(len(languages), 1e-6))
    for _ in range(rounds):
        found = words.mapInArrow(_expectations(model), "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces) + 1, len(languages)), 0.01)       # the last row: single characters outside the vocabulary
        counts[found["piece"].to_numpy(dtype=np.int64), [languages.index(x) for x in found["lang"]]] += found["n"].to_numpy()
        probs = counts / counts.sum(axis=0)
        model = Model(languages, pieces, probs[:-1], probs[-1] / 1000)  # spread over the characters it may stand for
    return model


def _predictions(model: Model | None):
    token = uuid.uuid4().hex

    def run(batches):
        kept = per_process(("langid",), dict)       # scores of the model in use, one model at a time
        if kept.get("token") != token:
            kept.update(token=token, scores=Remembered(CACHED_WORDS))
        scored = kept["scores"]
        for batch in batches:
            best, sure = [], []
            rows = [words_of(text) if text and model else [] for text in batch.column(batch.num_columns - 1).to_pylist()]
            new = list(scored.missing(set(chain.from_iterable(rows))))
            known = scored.young
            known.update(zip(new, model.score(new) if new else ()))
            for words in rows:
                if not words:
                    best.append("und")
                    sure.append(0.0)
                    continue
                scores = map(known.__getitem__, words)
                sums = [math.fsum(x) for x in zip(*scores)]
                top = max(sums)
                shares = [math.exp(max(-700.0, x - top)) for x in sums]
                at = sums.index(top)
                best.append(model.languages[at])
                sure.append(1 / math.fsum(shares))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score (probability of that language among the learned ones) for every row.

    ``und`` with score 0 where the text is null, empty or without a letter, or nothing was learned.  Ties go to the first language by
    name.  The whole text counts, word by word; nothing is shuffled.
    """
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    return rows.mapInArrow(_predictions(model), f"{kinds}, lang_pred string, score double").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def held_out(key: str = "doc_id"):
    """True for the quarter of the documents that training never sees."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang", **training) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents that are not held out.

    A null key is in neither part: it is not held out and teaches nothing.
    """
    model = train(docs.filter(F.col(key).isNotNull() & ~held_out(key)), pieces, text, lang, **training)
    return predict(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"), held_out(key).alias("held_out")), model, "_t", ("doc_id", "held_out"))

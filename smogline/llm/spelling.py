"""Spelling variants by pivotal grams.

Bigrams are ordered from rare to frequent over the distinct words.  A word's prefix is its three rarest bigrams (with all that tie with the third);
two of them that do not overlap are its pivots, chosen by dynamic programming over their places.  One edit spoils one pivot at most.  So
of two words one edit apart, the one whose prefix ends earlier in the order has a pivot that stands, one place off at most, in
the other's prefix; the index holds both directions, so the order need not be looked at.

Position limits make the meeting exact.  If the right pivot is spoiled or something to its right changed, everything up to the left pivot is
whole; otherwise everything from the right pivot on is.  What lies beyond the pivot has one edit, so one of its halves is whole
too.  A key is the whole part, the whole half and the other word's length; candidates are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from smogline.llm.common import by_sorting, staged

MIN_LENGTH = 7
MIN_COUNT = 2
DROP_ONE_IN = 31
FORM_FACTOR = 10
GRAM = 2
PREFIX = GRAM + 1       # bigrams that one edit can spoil, and one more
SPREAD = 8              # how much rarer a pivot's side is taken to be for each further letter
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LONG = 1 << 20


def _counted(min_length: int, drop_one_in: int):
    # a run shorter than min_length cannot give a word, and the greedy pattern takes maximal runs
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches):
        for batch in batches:
            n = Counter()
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                found = runs.findall(text) if len(text) < _LONG else (m.group() for m in runs.finditer(text))
                for word, times in Counter(found).items():
                    h = zlib.crc32(f"{key}:{word}".encode())
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= min_length:
                        n[word] += times
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences.

    A word is a maximal run of Latin letters with A-Z in lower case; one run in ``drop_one_in``, chosen by the CRC-32 of document key and run, loses a letter.
    A null key counts as the empty text; null texts have no words.
    """
    read = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(_counted(min_length, drop_one_in), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _pivots(prefix: list[tuple[int, int]], length: int) -> tuple[int, int]:
    """Places of the two disjoint bigrams of least cost among (place, frequency), by one pass from left to right.

    The left pivot stands for the words that share all up to it, the right one for those that share all from it on: the cost is the bigram's
    frequency, less for each further letter shared.
    """
    best, answer, waiting = None, None, []
    for place, f in sorted(prefix):
        while waiting and waiting[0][0] + GRAM <= place:
            left, cost = waiting.pop(0)
            best = min(best, (cost, left)) if best else (cost, left)
        if best and (answer is None or best[0] + f * SPREAD ** -float(min(300, length - GRAM - place)) < answer[0]):
            answer = (best[0] + f * SPREAD ** -float(min(300, length - GRAM - place)), best[1], place)
        waiting.append((place, f * SPREAD ** -float(min(300, place))))
    return answer[1:]


def _keys(word: str, at: int, own: int, other: int) -> tuple[str, str]:
    """The two texts under which words meet that agree up to the bigram at ``at``, for the pivot's word of length ``own`` and one of length ``other``."""
    end = at + GRAM
    rest = own - end
    half = rest // 2
    return f"{other}<{word[:end + half]}", f"{other}>{word[:end]}>{word[len(word) - (rest - half):] if rest > half else ''}"


def _hashed(side: str, keys) -> list[int]:
    return [xxhash.xxh64_intdigest(side + k) - (1 << 63) for k in keys]


def _signatures(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """Index keys of a word's pivots and of its prefix."""
    length = len(word)
    grams = sorted((frequency[word[i: i + GRAM]], word[i: i + GRAM], i) for i in range(length - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][:2]
    prefix = [(i, f) for f, g, i in grams if (f, g) <= last]
    left, right = _pivots(prefix, length)
    turned = word[::-1]
    pivots = set()
    for other in (length - 1, length, length + 1):
        pivots.update(_hashed("P", _keys(word, left, length, other)))
        pivots.update(_hashed("S", _keys(turned, length - GRAM - right, length, other)))
    places = set()
    for i, _ in prefix:
        for own in (length - 1, length, length + 1):
            if own >= i + GRAM:
                places.update(_hashed("P", _keys(word, i, own, length)))
            if own >= length - i:
                places.update(_hashed("S", _keys(turned, length - GRAM - i, own, length)))
    return list(pivots), list(places)


def _index(frequency: dict[str, int], pivots: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                words, counts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                rows = [(k, w, n) for w, n in zip(words, counts) for k in _signatures(w, frequency)[0 if pivots else 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))], names=["key", "word", "n"])
    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by one inserted, deleted or replaced code point.

    Words have three bigrams at least.  The bigrams of the alphabet are at most 8,100, whatever the number of words, so their
    frequencies travel to the tasks as they are.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, GRAM))).alias("g"))
    frequency = {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}
    kind = "key bigint, word string, n bigint"
    left, right = (words.select("word", "n").mapInArrow(_index(frequency, pivots), kind) for pivots in (True, False))
    met = by_sorting(left).alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.word") != F.col("r.word")) & (F.levenshtein("l.word", "r.word", 1) == 1))
    both = F.array(F.struct(F.col("l.word").alias("word"), F.col("r.word").alias("near"), F.col("r.n").alias("near_n")),
                   F.struct(F.col("r.word").alias("word"), F.col("l.word").alias("near"), F.col("l.n").alias("near_n")))
    return met.select(F.explode(both).alias("p")).select("p.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the last: each round doubles the way, and n grows tenfold a step, so few rounds do."""
    hop = staged(forms.select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        ahead = hop.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hop = staged(by_sorting(hop.select("word", "root")).join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-hops")
        if not hop.filter("moved").limit(1).count():
            return hop.select("word", "root")


def variant_groups(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n).

    The form is the near word of largest n (ties: the least in code-point order) if it is ``factor`` times as frequent at least, else null; the root
    is the last of the forms of forms, or the word itself.
    """
    words = staged(words, "spelling-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    fits = -F.col("b.m") >= factor * F.col("n")
    judged = staged(by_sorting(words).join(best, "word", "left").select("word", F.when(fits, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                            F.when(fits, -F.col("b.m")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return by_sorting(judged).join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts (:func:`vocabulary`) with their variant groups (:func:`variant_groups`); no documents give no rows."""
    return variant_groups(vocabulary(docs, key, text))


def check_sql() -> str:
    """The same groups in DuckDB SQL: words one edit apart share what is left after deleting one code point."""
    from smogline.llm.prefixtrie import sql_crc32
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')) AS w FROM documents),
hashed AS (SELECT w, count(*) AS k, {sql_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs GROUP BY doc_id, w),
made AS (SELECT CASE WHEN h % {DROP_ONE_IN} = 0 THEN substring(w, 1, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS (SELECT DISTINCT word, n, length(word) AS len, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
          UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON w.word = a.rest
          UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word),
judged AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {FORM_FACTOR} * words.n THEN near END AS form, CASE WHEN top >= {FORM_FACTOR} * words.n THEN top END AS form_n
           FROM words LEFT JOIN best ON best.word = words.word),
chain AS (SELECT word, word AS at, form AS next FROM judged UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON j.word = c.next)
SELECT j.word, j.form, c.at AS root, j.n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n FROM judged j JOIN chain c ON c.word = j.word AND c.next IS NULL"""

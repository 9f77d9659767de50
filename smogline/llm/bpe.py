"""Byte-level BPE by corpus-level merge replay.

A batch of documents is split into words (the matches of the tokenizer's pattern); the distinct words that the task has
not met yet form one flat corpus of byte tokens.  An inverted index maps the rank of each mergeable pair to the places
where it stands; ranks are replayed in ascending order over the whole corpus, and each merge
touches only its two neighbours.  Documents are then the concatenation of their words' ids.

Work is per row and batch, so nothing is shuffled and no group can be hot.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from smogline.llm.common import Remembered, per_process, release

CACHED_WORDS = 150_000      # chunks and words whose ids a task remembers, twice; the rest is worked out again, with the same result
LASTING_WORDS = 300_000     # the same for a worker that keeps them from task to task
LONG_CHUNK = 200            # longer chunks and words are not remembered
BATCH_BYTES = 16_000_000    # text per batch of rows that goes back to Spark
ROUND_CHARS = 1_000_000     # characters cut into words at once; a longer text goes piece by piece
REPLAY_BYTES = 250_000      # bytes of new words merged at once, which take some 200 bytes of memory each

SAFE_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

# Code points that Unicode versions after 16 made letters or numbers.  The vocabulary's own library, built
# on version 16, splits them like punctuation.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the vocabulary lacks a token for some byte")
        self._base = max(ranks.values()) + 1
        self._pairs: dict[int, int] = {}        # rank of a pair's merge by a * base + b, -1 when there is none
        self._bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])     # the same for two bytes

    def merged(self, a: int, b: int) -> int:
        """Rank of the pair's merge, -1 when the vocabulary has none."""
        rank = self._pairs.get(a * self._base + b)
        if rank is None:
            rank = self._pairs[a * self._base + b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        return [np.frombuffer(raw, dtype="<u4").tolist() for raw in self.replay_packed(words)]

    def replay_packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers.

        ``ids`` is the flat corpus; a merge at place i writes the new id there and empties the right part's place.
        ``index`` holds, for every rank, the places whose pair merges to it, ``pair`` the rank at every place.  The lowest rank goes first and its places from
        left to right; when a merge opens a pair of lower rank, the places still waiting go back to the index, so that
        every word sees exactly the order lowest rank first, leftmost first.
        """
        if len(self._pairs) > 300_000:
            self._pairs.clear()
        out = [None if r is None else r.to_bytes(4, "little") for r in map(self.ranks.get, words)]
        split = [i for i, o in enumerate(out) if o is None]
        if not split:
            return out
        merged, base, known = self.merged, self._base, self._pairs
        parts = [words[i] for i in split]
        flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        bounds = np.cumsum([0, *map(len, parts)])
        places_of_all = np.arange(len(flat))
        after_, before, pair_ = places_of_all + 1, places_of_all - 1, np.full(len(flat), -1)
        after_[bounds[1:] - 1], before[bounds[:-1]] = -1, -1
        pair_[:-1] = self._bytes[flat[:-1], flat[1:]]
        pair_[bounds[1:] - 1] = -1
        order = np.argsort(pair_, kind="stable")[np.count_nonzero(pair_ < 0):]
        steps = np.flatnonzero(np.diff(pair_[order], prepend=-1)).tolist()
        firsts, places = pair_[order[steps]].tolist(), order.tolist()
        index = {r: places[a:b] for r, a, b in zip(firsts, steps, [*steps[1:], len(places)])}
        ids = np.array(self.single)[flat].tolist()
        right, left, pair = after_.tolist(), before.tolist(), pair_.tolist()      # next and last live place of the word, -1 beyond its ends
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for done, i in enumerate(places):
                if pair[i] != rank:
                    continue        # a neighbour took part of the pair
                j = right[i]
                ids[i], ids[j], pair[j] = rank, -1, -1
                right[i] = after = right[j]
                lower = False
                new = -1
                if after >= 0:
                    left[after] = i
                    new = known.get(rank * base + ids[after])
                    if new is None:
                        new = merged(rank, ids[after])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(order, new)
                        lower = new < rank
                pair[i] = new
                a = left[i]
                if a >= 0:
                    new = known.get(ids[a] * base + rank)
                    if new is None:
                        new = merged(ids[a], rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(a)
                        else:
                            index[new] = [a]
                            heapq.heappush(order, new)
                        lower |= new < rank
                    pair[a] = new
                if lower:
                    index.setdefault(rank, []).extend(places[done + 1:])
                    heapq.heappush(order, rank)
                    break
        live = np.array(ids)
        ends = 4 * np.concatenate(([0], np.cumsum(live >= 0)))[bounds]
        raw, ends = live[live >= 0].astype("<u4").tobytes(), ends.tolist()
        for i, a, b in zip(split, ends, ends[1:]):
            out[i] = raw[a:b]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def splitter(pattern: str):
    """The function that splits a text into the pattern's matches, reading letters and numbers as Unicode 16 has them."""
    newer = "".join("-".join(rf"\U{int(c, 16):08x}" for c in part.split("-")) for part in NEWER.split())
    plain, has_newer = regex.compile(pattern).findall, regex.compile(f"[{newer}]").search
    strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
    strict = regex.sub(r" \?\\p\{([LN])\}\+", lambda m: rf" ?(?:(?![{newer}])\p{{{m[1]}}})+", strict)
    strict = regex.compile(strict).findall
    return lambda text: plain(text) if text.isascii() or not has_newer(text) else strict(text)


class Encoder:
    """Encodes texts, remembering the ids of chunks and words met before.

    A chunk runs from one space to the next.  The pattern lets a single space start a word, so it always splits before a space
    that stands between other characters; the words of a text are the words of its chunks.  Texts with more
    white space next to a space are split whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN, remembered: int = CACHED_WORDS):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self._white = re.compile(r"\s\s").search
        self.chunks, self.words = Remembered(remembered), Remembered(remembered)

    def odd(self, text: str) -> bool:
        return text.endswith(" ") or self._white(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        About ``ROUND_CHARS`` characters are in work at a time, so memory beside the ids does not grow with the number of texts nor with
        their length.
        """
        out = []
        for a, b in _rounds(list(map(len, texts)), ROUND_CHARS):
            if b - a == 1 and len(texts[a]) > ROUND_CHARS:
                out.append(b"".join(self._round([piece])[0] for piece in _pieces(texts[a])))
            else:
                out += self._round(texts[a:b])
        return out

    def _round(self, texts: list[str]) -> list[bytes]:
        rows = [[t] if self.odd(t) else _chunks(t) for t in texts]
        fresh = {c: self.split(c) for c in self.chunks.missing(set(chain.from_iterable(rows)))}
        words = list(self.words.missing(set(chain.from_iterable(fresh.values()))))
        known = self.words.young
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for a, b in _rounds(list(map(len, raw)), REPLAY_BYTES):
            known.update(zip(words[a:b], self.vocabulary.replay_packed(raw[a:b])))
        made = {c: b"".join(map(known.__getitem__, parts)) for c, parts in fresh.items()}
        _forget_long(known, words)
        known = self.chunks.young
        known.update(made)
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        _forget_long(known, made)
        return out


def _forget_long(known: dict, keys) -> None:
    for key in keys:
        if len(key) > LONG_CHUNK:
            del known[key]


def _chunks(text: str) -> list[str]:
    if "\0" not in text:
        return text.replace(" ", "\0 ").split("\0")
    first, *rest = text.split(" ")
    return [first, *(" " + c for c in rest)]


def _pieces(text: str):
    """A text cut after every ``ROUND_CHARS`` characters at the next single space between ASCII letters or digits, where the pattern always splits."""
    start = 0
    while start < len(text):
        cut = SAFE_CUT.search(text, start + ROUND_CHARS)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def _rounds(sizes: list[int], most: int):
    """Slices of things of these sizes, each of at most ``most`` together or one alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total + size > most and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _encoder(ranks_file: str, keep_ids: bool, lasting: bool):
    def run(batches):
        made = lambda: Encoder(Vocabulary(load_ranks(ranks_file)), remembered=LASTING_WORDS if lasting else CACHED_WORDS)
        if not lasting:
            release()       # what an earlier stage kept in this worker
        encoder = per_process(("bpe", ranks_file), made) if lasting else made()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in _rounds(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BATCH_BYTES):
                counts, id_digests, text_digests, all_ids = [], [], [], []
                for raw in encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()]):
                    ids = np.frombuffer(raw, dtype="<u4")
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(raw).hexdigest())
                    text_digests.append(hashlib.sha256(encoder.vocabulary.decode(ids.tolist())).hexdigest())
                    if keep_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                columns += [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode_documents(docs: DataFrame, ranks_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, lasting: bool = True) -> DataFrame:
    """The columns of ``keep`` with n_tokens, ids_sha256, decoded_sha256 and (if wanted) ids (array of int) of every row's text.

    Each match of the tokenizer's pattern is encoded by itself, without special tokens; a null text counts as empty and has no
    ids (digests of the empty string).  ``decoded_sha256`` digests the bytes that the ids decode to.  Rows are neither dropped
    nor merged.  ``lasting`` keeps the ids of words met, twice as many, from task to task in a Python worker (under 300 MB); where other work follows in the same
    workers, without it they end with the task.  ``ranks_file`` must be readable on the executors.
    """
    taken = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*taken, F.col(text).alias("_text"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    out = rows.mapInArrow(_encoder(ranks_file, ids, lasting), f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})

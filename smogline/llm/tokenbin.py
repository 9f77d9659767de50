"""Token ids as flat binary files.

A partition is a range of document keys; it writes ``ids-<part>.bin`` (little-endian unsigned 16 or 32-bit ids on end, the smaller
width that holds the vocabulary), ``ends-<part>.bin`` (64-bit offset of each document's end, in ids, inside the file)
and ``keys-<part>.bin`` (64-bit document keys; -1 for null, told apart by ``null`` in the table).  A table (part, docs, nulls, tokens, width, base) says where each
partition starts in the whole corpus: its base is the prefix sum of the earlier partitions' tokens.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from smogline.llm.common import per_process, scratch_path, staged

CACHED_WORDS = 1_000_000    # chunks a worker remembers
CACHED_BYTES = 64_000_000   # and their bytes, with places
PIECE = 8_000_000           # characters encoded at once
MARKS = ".,;:!?"
SPACE = "\u0120"            # how byte-level vocabularies write a space
GATHERED = 50_000         # chunks whose ids are brought together at once
PART_BYTES = 16_000_000     # text per partition file, about
MAX_PARTS = 10_000          # most partition files; they only get larger beyond


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` on end."""
    done = np.cumsum(lengths)
    return pool[np.repeat(starts - done + lengths, lengths) + np.arange(done[-1] if len(done) else 0)]


class KnownChunks:
    """Ids of chunks met before, on end in one array; those not asked for longest are let go."""

    def __init__(self, width: str):
        self.words, self.pool = pa.array([], pa.large_string()), np.empty(0, dtype=width)
        self.starts, self.lengths, self.asked, self.round = *(np.empty(0, dtype=np.int64) for _ in range(3)), 0

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of every word, -1 where it is not known."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        self.asked[at[at >= 0]] = self.round
        return at

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of words not known so far."""
        places = len(self) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths, self.pool = np.concatenate((self.lengths, lengths)), np.concatenate((self.pool, ids))
        self.asked = np.concatenate((self.asked, np.full(len(words), self.round)))
        return places

    def age(self) -> None:
        """Begin a new round; places found before hold no longer."""
        self.round += 1
        if len(self) <= CACHED_WORDS and self.words.nbytes <= CACHED_BYTES:
            return
        latest = np.argsort(-self.asked, kind="stable")[:CACHED_WORDS * 3 // 4]
        held = np.cumsum(pc.binary_length(self.words).to_numpy()[latest] + 8)
        kept = np.sort(latest[held <= CACHED_BYTES * 3 // 4])
        self.words, self.asked = self.words.take(pa.array(kept)), self.asked[kept]
        self.pool, self.lengths = _gathered(self.pool, self.starts[kept], self.lengths[kept]), self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths


class CachingTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each distinct chunk of a task once.

    A chunk runs from one space to the next.  A byte-level tokenizer whose splitting pattern lets a single space start a word always
    splits before a space that follows and precedes other characters, so the chunks' ids on end are the text's ids.  Texts with
    white space next to a space go to the library whole.
    """

    def __init__(self, path: str, width: str):
        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.tokenizer.encode_special_tokens = True
        self.rare_space = re.compile(r"[^\S\n ]").search
        self.known = KnownChunks(width)
        self.marks = {m: i for i, m in enumerate(MARKS)}
        self.mark_ids = self._ids(list(MARKS))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.after_space[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        """White space next to a space, or any but spaces and newlines."""
        return "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or self.rare_space(text) is not None

    def _words(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks, their ids on end and how many each has, each after a space and without white space but newlines.  Many chunks go to the library as
        one text: only the first token of a chunk holds a space, so it marks where the chunk starts."""
        joined, alone = [c for c in chunks if c[-1] != "\n"], [c for c in chunks if c[-1] == "\n"]
        order, ids, lengths = [], [], []
        for a in range(0, len(joined), 256):
            part = joined[a: a + 256]
            raw = self._ids([" " + " ".join(part)])[0]
            starts = np.flatnonzero(self.after_space[raw])
            if len(starts) == len(part) and starts[0] == 0:
                order += part
                ids.append(raw)
                lengths.append(np.diff(starts, append=len(raw)))
            else:
                alone += part
        single = self._ids([" " + c for c in alone])
        return order + alone, np.concatenate([np.empty(0, dtype=self.width), *ids, *single]), np.concatenate([np.empty(0, dtype=np.int64), *lengths, [len(x) for x in single]]).astype(np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones, where the new ones are added."""
        self.known.age()
        at = self.known.find(words)
        new = words.filter(pa.array(at < 0)).to_numpy(zero_copy_only=False).tolist()
        # letters and digits before one mark are matches of their own, so the library need not see them with every mark
        marked = {c: c[:-1] for c in new if c[-1:] in self.marks and c[:-1].isalnum()}
        plain = list(dict.fromkeys(marked.get(c, c) for c in new))
        found = self.known.find(pa.array(plain, pa.large_string()))
        place = dict(zip(plain, found.tolist()))
        order, ids, lengths = self._words([c for c in plain if place[c] < 0])
        place.update(zip(order, self.known.add(order, ids, lengths).tolist()))
        if marked:
            base = np.array([place[c] for c in marked.values()], dtype=np.int64)
            mark = np.array([self.marks[c[-1]] for c in marked])
            # base and mark in turns; the marks' ids stand behind the pool
            sizes = np.array([len(x) for x in self.mark_ids])
            behind = len(self.known.pool) + np.cumsum(sizes) - sizes
            starts = np.stack((self.known.starts[base], behind[mark]), axis=1).ravel()
            turns = np.stack((self.known.lengths[base], sizes[mark]), axis=1)
            ids = _gathered(np.concatenate((self.known.pool, *self.mark_ids)), starts, turns.ravel())
            place.update(zip(marked, self.known.add(list(marked), ids, turns.sum(axis=1)).tolist()))
        at[at < 0] = [place[c] for c in new]
        return at

    def _even(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not odd: Arrow numbers the chunks, and memory is asked once for each distinct one."""
        chunks = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        firsts = chunks.offsets.to_numpy()
        flat = chunks.flatten().dictionary_encode()
        n, numbers = len(flat.dictionary), flat.indices.to_numpy().astype(np.int64)
        # first chunks stand after no space: they are numbered behind the others and go to the library as they are
        numbers[firsts[:-1]] = n + np.arange(len(texts))
        used = np.flatnonzero(np.bincount(numbers, minlength=n)[:n])
        heads = self._ids([t.split(" ", 1)[0] for t in texts])
        sizes = np.array([len(x) for x in heads])
        places = self._places(flat.dictionary.take(pa.array(used)))
        pool = np.concatenate((self.known.pool, *heads))
        starts, lengths = np.zeros(n + len(texts), dtype=np.int64), np.zeros(n + len(texts), dtype=np.int64)
        starts[used], starts[n:] = self.known.starts[places], len(self.known.pool) + np.cumsum(sizes) - sizes
        lengths[used], lengths[n:] = self.known.lengths[places], sizes
        out, ends = [], [np.zeros(1, dtype=np.int64)]
        for a in range(0, len(numbers), GATHERED):
            part = numbers[a: a + GATHERED]
            out.append(_gathered(pool, starts[part], lengths[part]).tobytes())
            ends.append(ends[-1][-1] + np.cumsum(lengths[part]))
        raw, cuts = b"".join(out), (np.concatenate(ends)[firsts] * np.dtype(self.width).itemsize).tolist()
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(odd, self._ids([texts[i] for i in odd])):
            out[i] = ids.tobytes()
        even = [i for i, ids in enumerate(out) if ids is None]
        piece = (np.cumsum([len(texts[i]) for i in even], dtype=np.int64) // PIECE).tolist()
        for _, rows in groupby(zip(piece, even), key=lambda x: x[0]):
            rows = [i for _, i in rows]
            for i, ids in zip(rows, self._even([texts[i] for i in rows])):
                out[i] = ids
        return out


def _filesystem(uri: str):
    """File system and path of a folder given as URI or local path."""
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else "file://" + os.path.abspath(uri))


def _put(fs, path: str, chunks) -> None:
    """Write under a name of this attempt's own, then rename: a repeated task never leaves half a file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    _replace(fs, own, path)


def _replace(fs, own: str, path: str) -> None:
    """Give a finished file its name; a task that is run again finds an equal file there, which some file systems refuse to overwrite."""
    if fs.get_file_info(path).type != pafs.FileType.NotFound and not isinstance(fs, pafs.LocalFileSystem):
        fs.delete_file(path)
    fs.move(own, path)


def _writer(tokenizer_file: str, folder: str, width: str, end_id: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = per_process(("tokenizer", tokenizer_file, width), lambda: CachingTokenizer(tokenizer_file, width)), np.array([end_id], dtype=width).tobytes()
        fs, root = _filesystem(folder)
        size = np.dtype(width).itemsize
        part, out, own, ends, keys, at = None, None, None, [], [], 0

        def close():
            out.close()
            _replace(fs, own, f"{root}/ids-{part:06d}.bin")
            _put(fs, f"{root}/ends-{part:06d}.bin", [np.array(ends, dtype="<i8").tobytes()])
            _put(fs, f"{root}/keys-{part:06d}.bin", [np.ma.filled(np.ma.array([k or 0 for k in keys], mask=[k is None for k in keys], dtype="<i8"), -1).tobytes()])
            return pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ends)], "nulls": [sum(k is None for k in keys)], "tokens": [at]},
                                              schema=pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            parts, ids, texts = (c.to_pylist() for c in batch.columns)
            for p, key, raw in zip(parts, ids, coder.encode([t or "" for t in texts])):
                if p != part:
                    if part is not None:
                        yield close()
                    part, ends, keys, at = p, [], [], 0
                    own = f"{root}/ids-{part:06d}.bin.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                out.write(raw + end)
                at += len(raw) // size + 1
                ends.append(at)
                keys.append(key)
        if part is not None:
            yield close()
    return run


def id_width(tokenizer_file: str, end_id: int) -> str:
    """The smaller of 16 and 32 bits that holds every id of the vocabulary and the end id."""
    size = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text",
                 width: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the ids of all texts, in ascending order of the key, and return (part, docs, nulls, tokens, width, base).

    Null keys come first, equal keys in the order of their texts; a null text counts as empty and yields the end id alone.  Cut points
    are quantiles of the key, found on the key column only; each partition is sorted and streamed to its file, so a task
    holds one batch.  Rows with equal keys stand in one partition: keys are expected to be nearly unique.  An empty table
    writes nothing.
    """
    width = width or id_width(tokenizer_file, end_id)
    key_column = F.col(key).cast("long")
    amount = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("n")).first()
    parts = int(min(MAX_PARTS, max(1, (amount["bytes"] or 0) // part_bytes)))
    marks = docs.agg(F.percentile_approx(key_column, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts)).alias("m")).first()["m"] if parts > 1 else []
    edges = F.array(*[F.lit(x) for x in sorted(set(marks or []))]).cast("array<long>")
    part = F.when(key_column.isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e < key_column))).cast("long") + 1
    rows = docs.select(part.alias("part"), key_column.alias("key"), F.col(text).alias("text"))
    sorted_rows = rows.repartitionById(len(set(marks or [])) + 2, F.col("part").cast("int")).sortWithinPartitions("part", F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    written = staged(sorted_rows.mapInArrow(_writer(tokenizer_file, folder, width, end_id), "part bigint, docs bigint, nulls bigint, tokens bigint"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # at most MAX_PARTS + 1 rows
    return written.withColumn("width", F.lit(np.dtype(width).itemsize)).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _ids_of(fs, path: str, width: str) -> np.ndarray:
    """The file's ids, memory-mapped where the file system is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=width, mode="r") if os.path.getsize(path) else np.empty(0, dtype=width)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=width)


def _reader(folder: str):
    def run(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _ids_of(fs, f"{root}/ids-{row['part']:06d}.bin", f"<u{row['width']}")
                ends, keys = (_ids_of(fs, f"{root}/{name}-{row['part']:06d}.bin", "<i8") for name in ("ends", "keys"))
                if len(ids) != row["tokens"] or len(ends) != row["docs"]:
                    raise ValueError(f"part {row['part']} holds {len(ids)} ids and {len(ends)} documents, not {row['tokens']} and {row['docs']}")
                starts = np.concatenate((np.zeros(min(1, len(ends)), dtype=np.int64), ends[:-1]))
                for a in range(0, len(ends), 4096):
                    b = min(a + 4096, len(ends))
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts[a:b], ends[a:b])]
                    named = pa.array(keys[a:b], pa.int64(), mask=np.arange(a, b) < row["nulls"])
                    yield pa.RecordBatch.from_arrays([named, pa.array(starts[a:b] + row["base"]), pa.array(ends[a:b] - starts[a:b]), pa.array(sums, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; a task reads one partition at a time."""
    return parts.repartitionById(max(1, (parts.agg(F.max("part")).first()[0] or 0) + 1), F.col("part").cast("int")).mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")

"""BPE, token files, language identification and page extraction."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings, strategies as st
from llmdata import row
from tokenizers import Tokenizer

from smogline.llm import bpe, common, langid, mainhtml, queries, tokenbin

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(bpe.load_ranks(RANKS))
ENCODER = bpe.Encoder(VOCABULARY)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(FILE)
WHOLE.encode_special_tokens = True


def ids(text):
    return np.frombuffer(ENCODER.encode([text])[0], dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aaabet \n\t'sd.1é漢"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_merge_replay_equals_library(text):
    assert ids(text) == PLAIN.encode_ordinary(text)
    assert VOCABULARY.decode(ids(text)) == text.encode()


def test_replay_of_long_words_and_all_code_points():
    for text in ("a" * 3000, "ab" * 2000, "é" * 1500, " " * 2000 + "x", "՘₏ x꟎1"):
        assert ids(text) == PLAIN.encode_ordinary(text)
    points = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c} b{c}{c} {c}" for c in points[i:i + 400]) for i in range(0, len(points), 400)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ENCODER.encode(texts)] == [PLAIN.encode_ordinary(t) for t in texts]


def test_words_are_replayed_packed_and_remembered(monkeypatch):
    """Words of the vocabulary and others side by side; what was met is not replayed again, in a lasting worker twice as much."""
    words = [w.encode() for w in (" the", "zqxj", "é", " unlikelywordx", "zqxj")]
    assert VOCABULARY.replay_packed(words) == [np.array(w, dtype="<u4").tobytes() for w in VOCABULARY.replay(words)]
    assert VOCABULARY.replay_packed([]) == [] and bpe._chunks("a\0b c") == ["a\0b", " c"] and bpe._chunks("") == [""]
    seen = []
    monkeypatch.setattr(bpe, "Encoder", lambda *a, remembered: seen.append(remembered) or ENCODER)
    for lasting in (True, False):
        list(bpe._encoder(RANKS, False, lasting)([]))
    assert seen == [2 * bpe.CACHED_WORDS, bpe.CACHED_WORDS]


def test_new_words_are_merged_in_bounded_rounds(monkeypatch, sentence):
    """Many new words, and one long text of any white space, are worked through piece by piece with the library's ids; nothing is replayed twice."""
    monkeypatch.setattr(bpe, "ROUND_CHARS", 4000, raising=False)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 1000, raising=False)
    vocabulary, sizes = bpe.Vocabulary(VOCABULARY.ranks), []
    replay = vocabulary.replay_packed
    vocabulary.replay_packed = lambda words: sizes.append(sum(map(len, words))) or replay(words)
    rng = random.Random(8)
    new = lambda n: " ".join("".join(rng.choice("abcdefghxyzé漢1") for _ in range(rng.randint(5, 12))) for _ in range(n))
    long = "".join(f"{new(3)}{rng.choice(['  ', ' ', chr(10) * 2 + ' ', chr(9) + ' ', ' . '])}{sentence(4)}" for _ in range(600))
    texts = [new(100), "", *(new(60) for _ in range(40)), long, "b" * 9000, long + " ", sentence(20)]
    encoder = bpe.Encoder(vocabulary)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == [PLAIN.encode_ordinary(t) for t in texts]
    assert len(sizes) > 20 and sorted(sizes)[-2] <= 1000 and max(sizes) == 9000     # a single word is not cut
    assert max(map(len, [*encoder.words.young, *encoder.chunks.young])) <= bpe.LONG_CHUNK
    assert list(bpe._rounds([5, 1, 1, 9, 3], 4)) == [(0, 1), (1, 3), (3, 4), (4, 5)] and list(bpe._rounds([], 4)) == []


def test_a_batch_of_new_words_takes_little_memory(monkeypatch):
    """30,000 distinct words in one batch: what is in work at a time stays small."""
    monkeypatch.setattr(bpe, "ROUND_CHARS", 30_000, raising=False)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 20_000, raising=False)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(300)) for _ in range(100)]
    encoder = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), remembered=1000)
    encoder.vocabulary.replay_packed([" ".join(texts).encode()])        # the table of pairs is filled
    tracemalloc.start()
    try:
        found = encoder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15e6, peak
    assert np.frombuffer(found[7], dtype="<u4").tolist() == PLAIN.encode_ordinary(texts[7])


def test_last_stage_lets_go_of_what_earlier_ones_kept():
    common.per_process(("decontam",), dict)["indexes"] = [1]
    batch = pa.RecordBatch.from_pydict({"k0": [1, 2, 3], "t": ["a b", None, "c" * 50]})
    out = [r for b in bpe._encoder(RANKS, True, False)([batch]) for r in b.to_pylist()]
    assert [r["ids"] for r in out] == [PLAIN.encode_ordinary(t) for t in ("a b", "", "c" * 50)] and [r["k0"] for r in out] == [1, 2, 3]
    assert common.per_process(("decontam",), dict) == {}
    common.release()


def test_replay_goes_back_to_a_lower_rank():
    """A vocabulary in which a merge opens a pair of lower rank: each word must still take its lowest pair first."""
    single = {bytes([b]): 100 + b for b in range(256)}
    ranks = single | {b"bc": 5, b"abc": 2, b"ab": 7, b"abcabc": 1, b"ca": 3}
    own = bpe.Vocabulary(ranks)
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode()
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if word in ranks:
                parts = [word]
                break
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert own.replay([word]) == [[ranks[p] for p in parts]], word


def test_encode_documents(table, odd_rows):
    out = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.encode_documents(table(odd_rows), RANKS).collect()}
    for r in odd_rows:
        want = PLAIN.encode_ordinary(r[1] or "")
        got = out[r[0], hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()]
        assert got["ids"] == want and got["n_tokens"] == len(want) and got["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
    assert bpe.encode_documents(table(odd_rows), RANKS, ids=False).count() == len(odd_rows) and bpe.encode_documents(table([]), RANKS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'sd.1é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunked_tokenizer_equals_library(text):
    coder = tokenbin.CachingTokenizer(FILE, "<u2")
    assert np.frombuffer(coder.encode([text])[0], dtype="<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_tokenizer_sees_each_chunk_once(monkeypatch, sentence):
    coder, given = tokenbin.CachingTokenizer(FILE, "<u2"), []
    library = coder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    coder.tokenizer = Counting()
    texts = [f"{sentence(i % 50)} one, two\nthree {i % 7}!" for i in range(400)]
    same = lambda: [np.frombuffer(x, dtype="<u2").tolist() for x in coder.encode(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    assert same()
    heads, chunks = [t.split(" ")[0] for t in texts], {c for t in texts for c in t.split(" ")[1:]}
    assert sum(map(len, given)) <= sum(map(len, heads)) + sum(len(c) + 1 for c in chunks)
    given.clear()
    assert same() and sorted(given) == sorted(heads)
    # what is let go for want of room is worked out again
    monkeypatch.setattr(tokenbin, "CACHED_WORDS", 20)
    monkeypatch.setattr(tokenbin, "PIECE", 3000)
    assert same() and same()
    coder.known.age()
    assert len(coder.known) <= 15
    monkeypatch.setattr(tokenbin, "CACHED_BYTES", 40)
    coder.known.age()
    assert coder.known.words.nbytes <= 100 and same()


def test_token_files_round_trip(spark, table, odd_rows, sentence):
    rows = odd_rows + [row(1000 + i * 37 % 500, sentence(i % 60)) for i in range(300)] + [row(20, "<|endoftext|> is text")]
    folder = tokenbin.token_folder(spark)
    parts = tokenbin.write_tokens(table(rows), FILE, 2, folder, part_bytes=20_000)
    assert parts.count() > 5
    got = tokenbin.read_tokens(parts, folder).collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        own = WHOLE.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = tokenbin.token_folder(spark)
    assert tokenbin.read_tokens(tokenbin.write_tokens(table([]), FILE, 2, empty), empty).count() == 0


def test_language_is_learned_and_held_out(spark, table, odd_rows):
    rng = random.Random(9)
    stems = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["straße", "über", "schön", "nicht"], "zz": ["слово", "мир", "друг"]}
    text = lambda lang: " ".join(rng.choice(stems[lang]) + rng.choice(["", "en", "s"]) for _ in range(12))
    rows = [row(i, text(lang), lang) for i, lang in enumerate(sorted(stems) * 60)]
    rows += [row(1000 + i, t, None) for i, t in enumerate([None, "", "12 34 !?", "² ³", "x" * 5000])] + [r for r in odd_rows if r[0] is None]
    out = {}
    for r in langid.identify(table(rows), langid.load_pieces(RANKS)).collect():
        out[r["doc_id"]] = r
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert all(out[r[0]]["lang_pred"] == r[2] for r in rows[:180])
    assert [out[1000 + i]["lang_pred"] for i in range(4)] == ["und"] * 4 and out[1004]["lang_pred"] in stems
    untaught = langid.identify(table([row(1, "text", None)]), langid.load_pieces(RANKS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in untaught] == [("und", 0.0)]
    assert langid.identify(table([]), ["a"]).count() == 0


def test_share_of_training_rows_never_rounds_to_none():
    assert langid.least_hash(4000, 100) == 2**63 - 1 and langid.least_hash(4000, 8000) == 2**62 and langid.least_hash(4000, 5 * 10**9) > 2**42


def test_forward_sums_all_segmentations():
    model = langid.Model(["l"], ["a", "b", "ab", "ba"], np.array([[0.3], [0.2], [0.4], [0.1]]), np.array([0.01]))

    def brute(word):
        if not word:
            return 1.0
        p = {"a": .3, "b": .2, "ab": .4, "ba": .1}
        return sum((p.get(word[:n], .01 if n == 1 else 0)) * brute(word[n:]) for n in (1, 2) if n <= len(word))
    for word in ("a", "abab", "babax", "xx"):
        assert abs(np.exp(model.score([word, "ab"])[0][0]) - brute(word)) < 1e-12
    # "ab" is one piece with 0.4 or two with 0.06
    counts = model.expected(["ab"], np.array([0]), np.array([2.0]))[:, 0]
    assert np.allclose(counts, [2 * .06 / .46, 2 * .06 / .46, 2 * .4 / .46, 0, 0, 0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="notice">We use cookies, lots of them, and more.</div>
<div id=main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph, of some
length, &eacute;t cetera &#8211; fine.<p>Second<br>one with <b>bold, text</b> and <a href=x>a link</a>.</p><ul><li>item one<li>item two</ul>
<form><input><button>Send it</button></form><div class="ad">Buy this, now, please, thank you very much indeed.</div><blockquote>Quoted words</blockquote></article>
<section id="comments"><p>A reader's comment, which is long, has commas, and should go, surely.</p></section></div>
<aside class="sidebar"><p>Side text, that is long enough, to be scored, as a paragraph.</p></aside><footer>&copy; nobody</footer></body></html>"""


def test_article_text_only(spark):
    want = "Title & more\nFirst paragraph, of some length, ét cetera – fine.\nSecond one with bold, text and a link.\nitem one\nitem two\nQuoted words"
    assert mainhtml.main_text(PAGE) == want
    plain = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert mainhtml.main_text(plain) == want
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (None, "u", "", 5), (3, "u", "just text < 5 & more", 5), (4, "u", "<div>" * 3000 + "deep" + "</p>" * 10, 5), (1, "u", PAGE, 5), (5, "u", "<script>x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = [tuple(r) for r in mainhtml.extract_pages(pages).collect()]
    assert sorted(out, key=str) == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "u", "", 0), (3, "u", "just text < 5 & more", 20), (4, "u", "deep", 4), (5, "u", "", 0)], key=str)
    assert mainhtml.extract_pages(pages.limit(0)).count() == 0


RUN = "This paragraph runs on for a while, with commas, and it ends as sentences do."


def test_names_do_not_drop_article_text():
    body = (f"<article><h1>Title</h1><p>{RUN}</p><section id='discussion'><h2 class='section-header'>Discussion</h2><p class='side-note'>{RUN}</p></section>"
            f"<section id='related-work'><p>{RUN}</p></section><div class='legal'>{RUN}</div><div class='share'><a href=a>Post</a> <a href=b>Mail</a></div>"
            f"<div class='alert'>Log in</div><div class='comments'><p>{RUN}</p></div><p>Short end.</p></article>")
    assert mainhtml.main_text(f"<body><nav><a href=/>Home</a></nav>{body}<footer>x</footer></body>") == "\n".join(["Title", RUN, "Discussion", RUN, RUN, RUN, "Short end."])


def test_pages_without_article():
    page = (f"<body><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><h1>Head</h1><div><p>{RUN}</p><p>{RUN}</p></div><ul><li>first thing<li>second thing</ul>"
            f"<p>Short end.</p><ul><li><a href=3>Three more links</a></ul><p>&copy; Somebody</p></div><div id=sidebar><p>{RUN}</p></div></body>")
    assert mainhtml.main_text(page) == "\n".join(["Head", RUN, RUN, "first thing", "second thing", "Short end."])
    two = f"<body><div><article><p>{RUN}</p></article><article><h2>Second</h2><p>{RUN}</p></article></div></body>"
    assert mainhtml.main_text(two) == "\n".join([RUN, "Second", RUN])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "<a href='x'>", "</a>", "text, more", "<br/>", "<!--", "-->", "<", "&amp;", "</html>"]), max_size=40))
def test_broken_markup_never_fails(pieces):
    assert isinstance(mainhtml.main_text("".join(pieces)), str)


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))

"""Conversation trie, spelling variants and toxicity against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from llmdata import row, sends
from pyspark.sql import functions as F

from smogline.llm import prefixtrie, running, spelling, toxicity

TURNS = "conv_id long, turn long, role string, text string, depth string, c string"


def brute_trie(turns):
    said = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - c % 5, [])[:h] + own[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(built):
        ends[built[c]].append(c)
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].add(c)
    rows = []
    for k, m in members.items():
        subtree = [x for x in members if x[:len(k)] == k]
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in subtree),
                     sum(not any(len(y) > len(x) and y[:len(x)] == x for y in subtree) for x in subtree),
                     sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in subtree if x), hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.fixture
def conversations(sentence):
    rng = random.Random(11)
    openings = [("user", sentence(5)), ("system", "é" * 9), (None, None)]
    rows = []
    for c in range(120):
        texts = [openings[c % 3 if c % 4 else 0]] + [("user" if i % 2 else "assistant", f"t{rng.randint(0, 2)}") for i in range(rng.randint(0, 7))]
        rows += [(c, i if i else None, r, t, "x", "x") for i, (r, t) in enumerate(texts)]
    rows += [(700 + i, j, "user", "same", "x", "x") for i in range(40) for j in range(3)]       # many equal conversations
    rows += [(900, i // 2, "user", f"long {i % 7}", "x", "x") for i in range(400)] + [(None, 1, "user", "nobody", "x", "x"), (901, 2, "user", "a" * 50_000, "x", "x")]
    return rows


def trie_of(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(prefixtrie.numbered_turns(frame)))


def test_trie_matches_brute_force(spark, conversations, monkeypatch):
    # ties in turn: role, then text by digest; equal roles with tied turns get equal texts here
    rows = [r if r[0] != 900 else (r[0], r[1], r[2], f"long {r[1] % 7}", *r[4:]) for r in conversations]
    monkeypatch.setattr(prefixtrie, "CHUNK", 16)        # end lists of several pieces
    assert sorted(map(tuple, trie_of(spark, rows).collect()), key=str) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert trie_of(spark, []).count() == 0 and trie_of(spark, [(None, 1, "user", "x", "", "")]).count() == 0
    lone = trie_of(spark, [(1, None, None, None, "", "")]).collect()
    assert sorted(map(tuple, lone), key=str) == brute_trie([(1, None, None, None, "", "")])


def test_running_totals_over_ranges(spark):
    rows = [(0 if i < 700 else i % 5, i, (i * 37) % 11 - 5) for i in range(1000)]
    out = running.running(spark.createDataFrame(rows, "g long, i long, v long").repartition(7), ["g"], [F.col("i")], sums={"s": "v"}, xors={"x": "v"}).collect()
    seen = defaultdict(lambda: [0, 0, 0])
    want = []
    for g, i, v in sorted(rows):
        a = seen[g]
        a[0], a[1], a[2] = a[0] + 1, a[1] + v, a[2] ^ v
        want.append((g, i, v, *a))
    assert sorted((r["g"], r["i"], r["v"], r["rank"], r["s"], r["x"]) for r in out) == want


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for r in rows:
        for w in __import__("re").findall("[A-Za-z\u00c0-\u00ff]+", r[1] or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, []
    for w in n:
        about = [v for v in n if near(w, v)]
        best = min(about, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out.append([w, form[w], None, n[w], len(about), n[form[w]] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out), key=str)


@pytest.fixture
def misspelt(odd_rows):
    rng, rows = random.Random(3), list(odd_rows)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 11))) for _ in range(60)] + ["aaaaaaaa", "abababab", "Überraschung", "naïveté"]
    for i in range(400):
        words = []
        for _ in range(40):
            w = stems[min(rng.randrange(64), rng.randrange(64))]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + w[at]]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append(row(1000 + i, " ".join(words)))
    return rows


def test_variants_match_brute_force_and_sql(table, misspelt):
    docs = table(misspelt)
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=str)
    want = brute_variants(misspelt)
    assert got == want and sum(r[1] is not None for r in want) > 20 and sum(r[4] for r in want) > 500
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(map(tuple, con.sql(spelling.check_sql()).fetchall()), key=str) == want


def test_variants_of_odd_tables(table, odd_rows):
    assert spelling.spelling_variants(table([])).count() == 0
    assert spelling.spelling_variants(table(odd_rows[3:6])).count() == 0


def test_index_of_near_words_is_not_sent_to_every_task(spark):
    # a word makes some thirty index rows, and Spark takes their table to be as small as the one of words
    words = spark.createDataFrame([("variant", 30), ("varient", 2), ("another", 5)], "word string, n bigint")
    near = spelling.near_words(words)
    assert {(r["word"], r["near"]) for r in near.collect()} == {("variant", "varient"), ("varient", "variant")}
    assert not sends(near) and not sends(spelling.variant_groups(words))


def test_forms_are_followed_to_the_last(spark):
    words = [("aaaabbbb", 10_000), ("aaaabbbc", 900), ("aaaabbcc", 80), ("aaaabccc", 7), ("zzzzyyyy", 3)]
    out = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert out["aaaabccc"] == ("aaaabbcc", "aaaabbbb", 1) and out["aaaabbbb"] == (None, "aaaabbbb", 1) and out["zzzzyyyy"] == (None, "zzzzyyyy", 0)


def test_index_finds_the_exact_nearest():
    rng = random.Random(8)
    vectors = []
    for _ in range(900):
        v = {rng.randrange(60): rng.random() + 0.1 for _ in range(rng.randint(1, 6))}
        size = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / size for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors)
    skipped = 0
    for q in range(0, 900, 9):
        query = vectors[q]
        scores = [(round(sum(w * v.get(t, 0.0) for t, w in sorted(query.items())), 12), i) for i, v in enumerate(vectors)]
        want = sorted(((s, i) for s, i in scores if s > 0 and i != 5), key=lambda x: (-x[0], x[1]))[:10]
        got = index.nearest(query, 10, skip=5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-11)
        assert all(dict((i, s) for s, i in scores)[i] == pytest.approx(s, abs=1e-11) for s, i in got)
        skipped += len(index.blocks) - index.scored
    assert skipped > 0      # bounds spare blocks


def test_isotonic_rates_rise():
    x, y = toxicity.isotonic([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 1), (0.9, 1, 2), (0.9, 1, 1)])
    assert x == sorted(x) and y == sorted(y) and y[0] == 0 and y[-1] == 1


def test_toxicity_on_held_out_rows(spark, table, odd_rows, sentence):
    rng = random.Random(4)
    insults = ["blarg", "snorfle", "quixxed", "grumbly"]
    rows, labels = list(odd_rows), []
    for i in range(600):
        words = sentence(60).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "s", "ing"]))
        rows.append(row(1000 + i, " ".join(words)))
        labels.append((1000 + i, int(i % 5 == 0)))
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (99_999, 1)], "doc_id long, toxic int")
    out = toxicity.judge_toxicity(table(rows), marks).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    known = dict(labels)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert len(tested) > 100 and sum(r["predicted"] == known[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    empty = [r["score"] for r in out if r["doc_id"] in (3, 4, 5)]
    assert len(set(empty)) == 1 and empty[0] < 0.1
    first = max(tested, key=lambda r: r["score"])
    assert first["nearest"] and first["terms"] and known[first["nearest"][0]["doc_id"]] == 1


def test_toxicity_without_labels(spark, table, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.judge_toxicity(table(odd_rows), none).collect()} == {0.0}
    assert toxicity.judge_toxicity(table([]), none).count() == 0

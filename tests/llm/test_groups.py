"""SimHash components, shards and license scans against brute force."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from llmdata import row, sends

from smogline.llm import components, jaccard, license, sharding, simhash


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(keys, prints, limit=4):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    bits = np.array(prints, dtype=np.uint64)
    for i in range(len(bits)):
        for j in np.nonzero(np.bitwise_count(bits[i] ^ bits) <= limit)[0].tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(keys))]


def test_components_match_brute_force(spark, table, odd_rows, sentence):
    base = sentence(300).split()
    rows = list(odd_rows)
    for i in range(60):     # near copies of one text
        rows.append(row(100 + i, " ".join(base[:i * 5] + ["edit%d" % i] + base[i * 5:])))
    rows += [row(300 + i, sentence(3 + i % 40)) for i in range(100)]
    rows += [row(500, base[0] + " shared text of two ids"), row(501, base[0] + " shared text of two ids"), row(501, sentence(50))]     # an id with a copy and a text of its own
    got = simhash.near_duplicates(table(rows)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], (format(p, "016x") for p in prints), smallest_reachable([r[0] for r in rows], prints)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = simhash.keep_one_per_group(table(rows))
    component = dict(zip(prints, smallest_reachable([r[0] for r in rows], prints)))
    stay = [r for r, p in zip(rows, prints) if r[0] is None or r[0] == component[p]]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(r[0]), str(r[1])) for r in stay) and any(r[0] == 501 for r in stay)
    assert simhash.near_duplicates(table([])).count() == 0


def test_stage_finds_near_copies_beyond_four_bits(table, sentence):
    rows, rng = [], np.random.default_rng(3)
    for g in range(30):     # up to six changed words in 160: similarity from 1 down to about 0.68
        base = sentence(160).split()
        for m in range(3):
            words = list(base)
            for at in rng.choice(160, m * (1 + g % 3), replace=False).tolist():
                words[at] = f"edit{g}x{m}x{at}"
            rows.append(row(1 + 3 * g + m, " ".join(words)))
    base = sentence(60).split()     # a large group, every member another word changed
    rows += [row(1000 + i, " ".join(base[:i % 60] + [f"other{i}"] + base[i % 60 + 1:])) for i in range(150)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    prints = [fingerprint(r[1]) for r in rows]
    top = list(range(len(rows)))
    for _ in rows:
        old = list(top)
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4:
                    top[i] = top[j] = min(top[i], top[j])
        if old == top:
            break
    want = sorted({rows[t][0] for t in top})
    kept = sorted(r["doc_id"] for r in simhash.keep_one_per_group(table(rows)).collect())
    assert kept == want and len(want) < len(set(smallest_reachable([r[0] for r in rows], prints)))


@pytest.mark.parametrize("bands", [6, 7, 8])
def test_dense_and_chained_fingerprints(spark, bands):
    rng = np.random.default_rng(bands)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = []
    for c in centre:
        for _ in range(40):     # chains of small steps around each centre, some at the limit
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.append(int(c) ^ sum(1 << int(b) for b in flips))
    prints = sorted(set(prints) | {0, 15, 255, 2**64 - 1})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = {r["bits"]: r["root"] for r in simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "bits long"), bands=bands).collect()}
    want = smallest_reachable(list(range(len(prints))), prints)
    groups, expected = {}, {}
    for p, w in zip(signed, want):
        groups.setdefault(found[p], set()).add(p)
        expected.setdefault(w, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_component_search_on_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while high - low > 1:
        mid, need, fill = (low + high) // 2, 1, 0
        for s in sizes:
            need, fill = (need, fill + s) if fill + s <= mid else (need + 1, s)
        low, high = (low, mid) if need <= shards and max(sizes) <= mid else (mid, high)
    return high


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_minimax(table, odd_rows, sentence, shards):
    rows = odd_rows + [row(100 + i, sentence(1 + i * i % 90)) for i in range(150)] + [row(400 + i, "one copy of many") for i in range(80)]
    out = sharding.shard_documents(table(rows), shards).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(((x[0], size(x[1]), zlib.crc32((x[1] or "").encode())) for x in rows), key=str)
    where, slots, load = {}, {}, {}
    for r in out:
        assert where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    groups = {}
    for x in rows:
        first, total = groups.get(x[1] or "", (None, 0))
        groups[x[1] or ""] = (x[0] if first is None else first if x[0] is None else min(first, x[0]), total + size(x[1]))
    ordered = [t for _, t in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0]))]
    assert max(load.values()) == least_capacity(ordered, shards)


def test_shards_of_nothing(table):
    assert sharding.shard_documents(table([]), 8).count() == 0


def test_license_scan_matches_sql_and_brute_force(spark, table, odd_rows, sentence):
    rows = [r for r in odd_rows if r[0] not in (2, None)]
    rows += [row(100, "ALL Rights reserved cc-by CC BY cc by general public license"), row(101, "all rights\nreserved; all rights é reserved"), row(102, "cc"),
             row(103, "Licensed under the Apache License, Version 2.0 (see file)"), row(104, "permission is hereby granted free of any charge to any person obtaining a copy of this software"),
             row(105, sentence(50) + " Released under the MIT License. " + sentence(50)), row(106, "Kelvin K ıİ all rights reserved"), row(107, "the general public the license public")]
    out = license.scan_licenses(table(rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for key, text in ((r[0], r[1]) for r in rows):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
        r = got[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))), key
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[103]["labels"] == "apache-2" and got[104]["labels"] == "mit" and got[104]["score"] < 1 and got[105]["labels"] == "mit"
    assert [s["start"] for s in got[100]["spans"]] == [0, 3, 5, 7, 9]
    con = duckdb.connect()
    docs = table(rows).select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM docs")
    want = con.sql(license.check_sql())
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    # repeated rows and null keys
    assert license.scan_licenses(table(odd_rows)).count() == len(odd_rows) and license.scan_licenses(table([])).count() == 0


def test_copies_edited_apart_do_not_meet_pair_by_pair(table, sentence, monkeypatch):
    rng, words = np.random.default_rng(8), sentence(160).split()
    rows = []
    for i in range(160):    # similarity 0.5 to 0.8 to each other, 0.69 to 0.94 to the text they come from
        own = list(words)
        for at in rng.choice(160, 1 + i % 6, replace=False).tolist():
            own[at] = f"own{i}x{at}"
        rows.append(row(i, " ".join(own)))
    made = []

    def counted(pairs, sets):
        made.append(pairs.count())
        return verified(pairs, sets)
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", counted)
    kept = sorted(r["doc_id"] for r in simhash.keep_one_per_group(table(rows)).collect())
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    prints = [fingerprint(r[1]) for r in rows]
    top = list(range(len(rows)))
    for _ in rows:
        old = list(top)
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4:
                    top[i] = top[j] = min(top[i], top[j])
        if old == top:
            break
    assert kept == sorted(set(top)) and len(kept) > 20
    assert made[1] < 4 * len(rows)      # stray texts met all others before


def test_cells_and_stars_are_not_sent_to_every_task(spark, monkeypatch):
    # a row explodes to 16 keys and 35 cells, and Spark takes those tables to be as small as the file of fingerprints
    made, staged, components = {}, simhash.staged, simhash.components
    monkeypatch.setattr(simhash, "staged", lambda df, label: made.setdefault(label, df) and staged(df, label))
    monkeypatch.setattr(simhash, "components", lambda links: made.setdefault(f"links {len(made)}", links) and components(links))
    prints = spark.createDataFrame([(i << 3,) for i in range(64)], "bits bigint")
    assert {r["root"] for r in simhash.link_fingerprints(prints).collect()} == {0}
    pairs = [df for label, df in made.items() if label.startswith("links")][-1]
    assert "explode" in pairs._jdf.queryExecution().toString() and not sends(pairs) and not sends(made["simhash-stars"])


def test_near_dedup_sends_no_table_of_texts_to_every_task(table, sentence, monkeypatch):
    made, staged = {}, simhash.staged
    for module in (simhash, jaccard):
        monkeypatch.setattr(module, "staged", lambda df, label: made.setdefault(label, df) and staged(df, label))
    words = sentence(120).split()
    rows = [row(i, " ".join([*words[:90], *sentence(30).split()])) for i in range(12)] + [row(20 + i, sentence(40)) for i in range(4)]
    assert simhash.keep_one_per_group(table(rows)).count() >= 5
    grown = ("near-nodes", "near-met", "near-cells", "near-centres", "near-grouped", "near-prefixes", "near-unlike")    # rows for every cell or shingle
    assert [label for label in grown if sends(made[label])] == []

"""Quality rules, line dedup, decontamination and the pipeline against brute force on small tables."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from llmdata import row, sends

from smogline.llm import decontam, linededup, quality


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(table, odd_rows):
    rows = odd_rows + [row(100 + i, " ".join("ab c a b c d".split()[(i * k) % 6] for k in range(40))) for i in range(8)]
    out = quality.document_statistics(table(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, out), key=str) == sorted(((r[0], *statistics(r[1])) for r in rows), key=str)


def test_rules_are_learned_from_labels(spark, table, sentence):
    rows = [row(i, sentence(30) + (" %%%" * 12 if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(240)] + [(0, None), (9999, 1)], "doc_id long, quality int")
    docs = table(rows)
    out = quality.judge_quality(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out) and len(out) == 240
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(240) if i % 4]


def test_no_labels_reject_nothing(spark, table, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge_quality(table(odd_rows), none).collect()
    assert len(out) == len(odd_rows) and all(r["kept"] != r["base_failed"] and r["rule"] is None for r in out)
    assert quality.judge_quality(table([]), none).count() == 0


def text_left(rows, run_words=linededup.RUN_WORDS, share=linededup.BOILERPLATE):
    """Brute force over all units: {(no key, key, text): text without the runs}."""
    keys = sorted({(x[0] is None, x[0] or 0, x[1]) for x in rows if x[1] is not None})
    units = {k: [(u, re.sub(r"[\W_]+", " ", u.lower()).strip()) for u in re.split(r"(\n|(?<=[.!?]) )", k[2])] for k in keys}
    spread = Counter(u for k in keys for u in {u for _, u in units[k][::2]})
    common = {u for u, n in spread.items() if n >= max(2, share * len(rows))}
    seen, out = set(), {}
    for k in keys:
        later = []
        for _, u in units[k][::2]:
            later.append(None if not u else u in seen)
            seen.add(u)
        words, gone, at = [len(u.split()) for _, u in units[k][::2]], set(), 0
        while at < len(later):
            run = []
            while at < len(later) and later[at] is not False:
                run += [at] if later[at] else []
                at += 1
            if sum(words[i] for i in run) >= run_words or any(units[k][2 * i][1] in common for i in run):
                gone.update(run)
            at += 1
        left = "".join(raw + (units[k][2 * i + 1][0] if 2 * i + 1 < len(units[k]) else "") for i, (raw, _) in enumerate(units[k][::2]) if i not in gone)
        out[k] = left[:-1] if len(later) - 1 in gone and left else left
    return out


def test_substring_dedup_matches_brute_force(table, odd_rows, sentence):
    short, shared, common = [sentence(4) + "." for _ in range(29)], [sentence(9) + "." for _ in range(8)], sentence(5)
    rows = [row(50 + i, f"{sentence(25)}\n{' '.join(shared).upper() if i % 2 else ' '.join(shared) + ' !'}\n{sentence(3)}") for i in range(4)] + odd_rows[3:6] + [row(None, " ".join(shared))]
    rows += [row(80 + i, f"{short[i % 29]} {sentence(12)}. {short[(i * 2) % 29]} {short[(i * 4) % 29]}\n{sentence(6)}") for i in range(30)]
    rows += [row(120 + i, f"{sentence(12)}. {' '.join(shared[2:6])} {sentence(12)}.\n{common}") for i in range(14)]
    out = {(r["doc_id"], r["n_chars"]): r for r in linededup.dedup_lines(table(rows)).collect()}
    assert len(out) == len(rows)
    want, cut, kept_repeats = text_left(rows), 0, 0
    for x in rows:
        got = out[x[0], x[4]]
        if x[1] is None:
            assert got["text"] is None and got["removed"] == []
            continue
        assert got["text"] == want[x[0] is None, x[0] or 0, x[1]]
        cut += len(got["removed"])
        for span in got["removed"]:
            assert x[1][:span["start"]].count("\n") == span["line"] and len(x[1][span["start"]: span["start"] + span["length"]]) == span["length"]
        assert sum(s["length"] for s in got["removed"]) <= len(x[1]) - len(got["text"])
        kept_repeats += 80 <= (x[0] or 0) < 110 and got["text"] == x[1]
    assert cut >= 30 and kept_repeats == 30      # passages inside lines go, chance repeats of short sentences stay


def test_line_dedup_odd_tables(table, odd_rows):
    docs = table(odd_rows)
    out = linededup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "removed"] + ["removed"] and out.count() == len(odd_rows)
    # rows equal in key and text share one fate
    assert {r["text"] for r in out.filter("doc_id = 2").collect()} == {""} and out.filter("doc_id = 1").first()["text"] == odd_rows[0][1]
    assert linededup.dedup_lines(table([])).count() == 0


def test_leaks_match_brute_force(spark, table, odd_rows, sentence):
    items = [(i, sentence(14).capitalize() + ". " + sentence(9).capitalize() + ".") for i in range(30)] + [(30, sentence(150)), (31, None), (32, ""), (33, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [row(1000 + i, f"{sentence(90 * (i % 4))} {items[i % 31][1].upper()} {sentence(40)}") for i in range(40)]
    rows += [row(2000 + i, sentence(120)) for i in range(30)] + odd_rows
    # half a leak is none
    rows += [row(3000, sentence(50) + " " + " ".join(items[3][1].split()[:11]) + " " + sentence(50))]
    found = decontam.leaked_items(table(rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(1000 + i, i % 31) for i in range(40)}
    kept = decontam.drop_leaks(table(rows), bench)
    assert kept.columns == table([]).columns and kept.count() == len(rows) - 40
    assert decontam.leaked_items(table(rows), bench.limit(0)).count() == 0 and decontam.leaked_items(table([]), bench).count() == 0


def test_many_passes_find_the_same(spark, table, sentence, monkeypatch):
    items = [(i, sentence(20)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table([row(i, sentence(30) + " " + items[i][1] + " " + items[(i * 7) % 40][1]) for i in range(40)])
    once = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaked_items(docs, bench).collect())
    monkeypatch.setattr(decontam, "PASS_ITEMS", 11)
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 4)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaked_items(docs, bench).collect()) == once and len(once) >= 40


def test_retrieval_matches_plain_bm25(sentence, monkeypatch):
    """WAND and block bounds lose nothing against scoring every passage with every entry, and an entry's score does not depend on its shard."""
    rng = random.Random(1)
    items = [(i, f"{sentence(rng.randint(3, 90))}. {sentence(rng.randint(1, 9))}") for i in range(60)]
    texts = [decontam.words_of(t) for t in [f"{sentence(40)} {items[i][1]} {sentence(70)}" for i in range(0, 60, 3)] + [sentence(200), "", sentence(5), items[4][1][:60]]]
    statistics = decontam.Statistics().add(items)
    entries = [(i, e) for i, (_, t) in enumerate(items) for e in decontam.entries_of(sum(decontam.question_and_answer(t), []))]
    assert sum(len(e) for _, e in entries) == sum(len(decontam.words_of(t)) for _, t in items)      # no tail is lost
    n, mean = len(entries), sum(len(e) for _, e in entries) / len(entries)
    frequency = Counter(w for _, e in entries for w in set(e))
    want = {}
    for x, words in enumerate(texts):
        for a in range(0, max(1, len(words)), decontam.STRIDE):
            if a and a + decontam.STRIDE >= len(words) + decontam.STRIDE:
                continue
            here = set(words[a: a + 2 * decontam.STRIDE])
            for i, e in entries:
                w = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(e) / mean)) for t, f in Counter(e).items()}
                score = sum(v for t, v in w.items() if t in here) / sum(w.values())
                if score >= decontam.RETRIEVE:
                    want[x, i, a] = max(score, want.get((x, i, a), 0))
    for shard in (7, 60):
        got = {}
        for a in range(0, 60, shard):
            index = decontam.Index(items[a: a + shard], statistics)
            for x, i, score, at in index.retrieve(texts):
                got[x, a + i, at] = max(score, got.get((x, a + i, at), 0))
        last = {k: v for k, v in want.items() if k in got or k[2] == 0 or k[2] + decontam.STRIDE < len(texts[k[0]])}
        assert got.keys() == last.keys() and all(abs(got[k] - v) < 1e-6 for k, v in last.items()) and len(got) > 30


def test_question_alone_is_no_leak(spark, table, sentence):
    question, answer = sentence(20), sentence(8)
    bench = spark.createDataFrame([(1, f"{question}? {answer}")], "item_id long, text string")
    found = decontam.leaked_items(table([row(1, f"{sentence(30)} {question}? {sentence(30)}"), row(2, f"{question}? {answer} {sentence(9)}")]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(2, 1)]


def test_pipeline_on_a_small_folder(spark, table, sentence, tmp_path):
    items = [(i, sentence(30)) for i in range(5)]
    near = sentence(400).split()
    shared = sentence(60)
    rows = [row(i, sentence(60)) for i in range(120)]
    rows += [row(200, " ".join(near)), row(201, " ".join(near[:200] + ["changed"] + near[201:])), row(202, " ".join(near))]
    rows += [row(300, sentence(30) + "\n" + shared), row(301, sentence(40) + "\n" + shared), row(302, sentence(50) + " " + items[2][1])]
    rows += [row(400 + i, sentence(30) + " ###" * 20) for i in range(40)] + [row(500, "too short"), row(501, None)]
    docs = table(rows).drop("hits", "removed", "n_words", "_key", "_row", "row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(not 400 <= r[0] < 440)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, seen, str(tmp_path)).columns == docs.columns, name
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(120), 200, 300, 301]
    assert out[301]["n_tokens"] < out[300]["n_tokens"]      # the shared line went from the later document


def test_line_dedup_cuts_short_lines_and_wrapped_passages(table, sentence):
    wrapped = [sentence(6) for _ in range(12)]
    own = [sentence(7) for _ in range(6)]
    rows = [row(i, "\n".join([own[i], "---", "", *wrapped, "Ok", own[i + 3]])) for i in range(3)]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(table(rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["removed"] == []
    for i in (1, 2):        # lines without a word are no repeats
        assert out[i]["text"] == f"{own[i]}\n---\n\n{own[i + 3]}" and [s["line"] for s in out[i]["removed"]] == [3]


def test_labels_are_not_sent_to_every_task(spark, table, sentence, monkeypatch):
    made, staged = {}, quality.staged
    monkeypatch.setattr(quality, "staged", lambda df, label: made.setdefault(label, df) and staged(df, label))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int")
    assert quality.judge_quality(table([row(i, sentence(30)) for i in range(8)]), labels).count() == 8
    assert made["quality-labelled"].count() == 8 and not sends(made["quality-labelled"])


def test_only_the_hot_units_are_sent_to_every_task(table, sentence):
    copy = sentence(40)
    units = linededup._units(table([row(i, f"{copy}\n{sentence(5)}") for i in range(4)]), "doc_id", "text")
    plan = linededup._later(units, 100.0)._jdf.queryExecution().logical().toString()
    # units without the hot ones meet the other repeated ones by sorting
    assert "strategy=merge" in plan and linededup._later(units, 100.0).count() == 3

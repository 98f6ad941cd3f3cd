"""Each operator over documents against brute force, and over nulls, empties, repeats, clashing columns and no rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from labelscope.llm import common, decontaminate, deobfuscate, licenses, mixing, near_dup, quality, token_counts, toxicity
from labelscope.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, node string, n bigint"
LONG = "lorem ipsum dolor sit amet " * 30_000


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", "y", 7) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, clashing column names."""
    base = "one two three four five six seven eight nine ten"
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, base, "a"), (4, base, "a"), (5, base.upper(), None), (None, base, "a"), (6, LONG, "b"), (7, "!!! ???", "é")]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def oracle(name, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.execute(ORACLE[name]).df()


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op3_minhash_near_dedup", "op4_decontamination", "op8_mixing"])
def test_queries_equal_their_sql(spark, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), oracle(name, small)
    key = sorted(got.columns)
    a = got[key].sort_values(key).reset_index(drop=True)
    b = want[key].sort_values(key).reset_index(drop=True)
    assert len(a) > 0 and (a.values == b.values).all()


# near duplicates


def brute_components(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        at = rng.randrange(len(out))
        out[at] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs: dict[int, str | None] = {0: None, 1: "", 2: "a b", 3: "A  B", 4: "b a"}
    base = [[f"t{rng.randrange(400)}" for _ in range(rng.randint(30, 120))] for _ in range(25)]
    for i in range(5, 260):
        words = rng.choice(base)
        docs[i] = " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.05]))) + rng.choice(["", " tail", "\n"])
    monkeypatch.setattr(near_dup, "BLOCK", 7)  # many blocks to a list
    got = near_dup.near_duplicates(table(spark, [(i, t, "a") for i, t in docs.items()])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(odd).collect()), key=str)
    assert len(got) == 9 and got.count((4, 6, 4)) == 2 and (5, 6, 4) in got and (None, 6, None) in got
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (6, 5, 6) in got
    assert near_dup.near_duplicates(none).count() == 0


def test_family_of_long_near_copies_over_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    long = [f"t{rng.randrange(900)}" for _ in range(1500)]
    other = [f"u{rng.randrange(900)}" for _ in range(700)]
    docs: dict[int, str | None] = {i: " ".join(edited(rng, long, 0.004)) for i in range(120)}
    docs |= {200 + i: " ".join(edited(rng, long, 0.035)) for i in range(60)}  # some of them link with none, or with few
    docs |= {300 + i: " ".join(long[:800] + edited(rng, other, 0.01)) for i in range(40)}  # half a text in common with all
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 12_000)
    monkeypatch.setattr(near_dup, "ANCHORS", 2)
    got = near_dup.near_duplicates(table(spark, [(i, t, "a") for i, t in docs.items()])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_near_duplicates_of_repeated_ids_with_different_texts(spark):
    one, two, three = ("one two three four five six seven", "red green blue white black grey pink", "stone wood iron glass paper cloth sand")
    rows = [(1, one, "a"), (1, two, "a"), (2, one, "a"), (3, two, "a"), (4, three, "a"), (3, three, "a"), (5, None, "a"), (5, one, "b")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(table(spark, rows)).collect())
    # one and two are first seen in document 1 and are joined by it; three is first seen in document 3
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 3), (4, 3, 3), (5, 0, 5), (5, 3, 1)]


def test_connecting_pairs_connect_what_the_links_connect():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.append(s, rng.integers(0, 60, 4).astype(np.uint64))) for s in sets[:20]]
    n = len(sets)
    linked = {(i, j) for i in range(n) for j in range(i + 1, n) if (c := len(np.intersect1d(sets[i], sets[j]))) and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert len(linked) > 15

    def groups(pairs, of):
        root = list(of)
        for _ in range(n):
            for x, y in pairs:
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
        return [root.index(r) for r in root]

    block = np.arange(n) % 2
    for component in (np.arange(n), np.arange(n) // 3):
        a, b = near_dup.connecting_pairs(sets, component)
        pairs = set(zip(a.tolist(), b.tolist(), strict=True))
        assert {tuple(sorted(p)) for p in pairs} <= linked and groups(pairs, component) == groups(linked, component)
        a, b = near_dup.connecting_pairs(sets, component, block)
        assert groups(set(zip(a.tolist(), b.tolist(), strict=True)), component) == groups({p for p in linked if block[p[0]] != block[p[1]]}, component)


# decontamination


def brute_contamination(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        b = words(body)
        size = min(window, len(b))
        for at in range(len(b) - size + 1 if b else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == b[at : at + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force_in_one_and_many_parts(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 14, 30])))) for i in range(8)] + [(8, "!!"), (9, None), (None, "v1 v2")]
    docs = [(i, " ".join(rng.choice(vocabulary + ["zz"]) for _ in range(60)), "a") for i in range(30)]
    for i in range(30, 40):
        docs.append((i, "zz yy " + (items[i % 8][1] or "") + " xx " + (items[(i + 3) % 8][1] or ""), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_contamination(t, [x for x in items if x[0] is not None]) for i, t, _ in docs}
    monkeypatch.setattr(decontaminate, "SHARD_DOCS", 7)
    for limit in (1 << 20, 64):
        got = decontaminate.contamination(table(spark, docs), bench, broadcast_bytes=limit).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
        for r in got:
            assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"]
            assert all(a["last"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "three four FIVE")], "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.contamination(odd, bench).collect()]
    assert got.count((4, 10, 3)) == 2 and (5, 10, 3) in got and (None, 10, 3) in got and (1, 0, 0) in got and (7, 0, 0) in got
    assert decontaminate.contamination(none, bench).count() == 0
    empty = decontaminate.contamination(odd, bench.limit(0)).collect()
    assert len(empty) == 9 and all(r["n_hit"] == 0 for r in empty)


def test_spans_are_removed():
    assert decontaminate.remove_spans("A b c, d e.", [(1, 2)]) == "A , d e."
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# mixing


def test_targets_are_capped_and_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 80)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    assert {k: w for k, (w, _) in got.items()} == {"a": 1, "b": 2, "c": 3, None: 1}
    assert got["a"][1] == 30 and got["c"][1] == 30 and abs(got["b"][1] - 1040 * 2 / 3) > 100  # the null source is capped too
    assert got[None][1] == 240 and got["b"][1] == 800 and sum(t for _, t in got.values()) == 1100


def test_mix_takes_its_budgets(spark, odd, none):
    rows = [(i, "w " * (i % 13), f"s{i % 4}") for i in range(400)]
    got = mixing.mix_documents(table(spark, rows)).toPandas()
    by = got.groupby("source").agg({"taken": "sum", "target": "max", "source_size": "max"})
    assert ((by.target - by.taken).abs() < 1).all() and (got.taken <= 3 * got["size"]).all() and (by.target <= 3 * by.source_size).all()
    again = mixing.mix_documents(table(spark, rows[::-1]).repartition(5)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix_documents(odd).count() == 9 and mixing.mix_documents(none).count() == 0
    blank = mixing.mix_documents(table(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [r["taken"] for r in blank] == [0, 0]


# token counts


def test_counts_equal_the_library(spark, small, odd, none):
    with open(token_counts.vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    library = token_counts.load_tokenizer(text)
    rng = random.Random(4)
    alphabet = "abcXYZ '\"sßÉéñ¿!?.,-0129½²\n\t\r\x0b\x0c'llre've<|>…—€œŸµªº×İΣ́日\xa0\x85\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["x<|endoftext|>y", "don't WE'LL", "a" * 3000, "word " * 5000]
    counter = token_counts.Counter(text, token_counts.whole_tokens(text))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect()]
    assert (1, 0, 0) in got and (2, 0, 0) in got and (3, 4, 0) in got and got.count((4, 48, 10)) == 2 and (7, 7, 2) in got
    assert token_counts.count_tokens(none).count() == 0


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 10)
    parts = list(token_counts._pieces("aaaa bbbb cccc dddd eeee ffffffffffffffffffffff gg"))
    assert len(parts) > 2 and " ".join(parts) == "aaaa bbbb cccc dddd eeee ffffffffffffffffffffff gg"
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    with open(token_counts.vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    counter = token_counts.Counter(text, token_counts.whole_tokens(text))
    words = [f"qzx{i}" for i in range(30)]
    assert counter.count(" ".join(words)) == sum(len(counter.tokenizer.encode(w, add_special_tokens=False).ids) for w in words)


def test_phrases_of_16_mb_stay_small():
    import pickle
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(60_000)], object)
    texts = [" ".join(words[rng.integers(0, len(words), 150)]) for _ in range(18_500)]
    assert sum(map(len, texts)) > 16e6
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    phrases = decontaminate.Phrases([str(i) for i in range(len(texts))], pa.array(texts))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held - before < 120e6 and most - before < 500e6
    assert len(pickle.dumps(phrases, protocol=5)) < 100e6
    assert sum(len(p.starts) for p in phrases.by_length.values()) == 18_500 * 138


def test_windows_that_share_a_key_stay_apart(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"a{w}" for w in rng.integers(0, 3, 40)) for _ in range(12)]
    got = decontaminate.Phrases([str(i % 9) for i in range(12)], pa.array(texts), 4)
    monkeypatch.setattr(decontaminate.tk, "mix", lambda x: x & np.uint64(3))
    first = np.concatenate([np.arange(40 * i, 40 * i + 37) for i in range(12)])
    patterns = got._distinct(first, np.repeat(np.arange(12) % 9, 37), 4)
    want, found = {}, {}
    for i, text in enumerate(texts):
        for j in range(37):
            want.setdefault(tuple(text.split()[j : j + 4]), set()).add(i % 9)
    words = " ".join(texts).split()
    for k, at in enumerate(patterns.starts.tolist()):
        found.setdefault(tuple(words[at : at + 4]), set()).update(patterns.owners[patterns.offsets[k] : patterns.offsets[k + 1]].tolist())
    assert found == want


# licenses


def test_license_scan(spark, odd, none):
    rows = [
        (1, "All rights reserved. x ALL RIGHTS RESERVED", "a"), (2, "Licensed under CC BY-NC 4.0.", "a"), (3, "Released under the MIT License.", "a"), (4, "all rights", "a"),
        (5, "under the GNU General Public License, version 2", "a"), (6, "mit mit mit license", "a"), (7, "licensed under the apache license version 2.0 text", "a"), (8, None, "a"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 4, "reserved")
    assert got[2]["base_labels"] == "cc-by" and got[2]["labels"] == "cc-by,cc-by-nc" and got[2]["first_word"] == 2
    assert got[3]["labels"] == "mit" and got[3]["n_base"] == 0 and got[3]["first_word"] is None and 0 < got[3]["score"] <= 1
    assert got[4]["labels"] == "" and got[4]["score"] == 0 and got[5]["base_labels"] == "gpl" and got[7]["labels"] == "apache-2.0"
    assert (got[8]["n_words"], got[8]["n_base"], got[8]["labels"]) == (0, 0, "")
    assert licenses.scan_licenses(odd).count() == 9 and licenses.scan_licenses(none).count() == 0


def test_base_phrases_equal_brute_force(spark, small):
    got = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"] or ""))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert g["first_word"] == min((p for p, _ in places), default=None) and g["last_word"] == max((p for p, _ in places), default=None)


def brute_matches(index, words):
    """Every notice at every start, word by word."""
    found = {}
    for t, (label, text, keys) in enumerate(licenses.TEMPLATES):
        notice = text.split()
        for start in range(-len(notice), len(words)):
            coverage = sum(w for k, w in enumerate(index.weights[t]) if 0 <= start + k < len(words) and words[start + k] == notice[k])
            if coverage >= licenses.COVERAGE and all(f" {key} " in f" {' '.join(words)} " for key in keys):
                found[label, start] = max(coverage, found.get((label, start), 0))
    return found


def test_license_matches_equal_brute_force_without_the_rarest_words(spark):
    rng = random.Random(5)
    rows = []
    for t, (_, text, keys) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for k in range(12):
            lost = set(rng.sample(range(len(words)), min(len(words), k % 8)))
            body = [f"x{rng.randrange(50)}" if i in lost else w for i, w in enumerate(words)]
            rows.append((100 * t + k, " ".join([*(["lead"] * rng.randrange(3)), *body, *(" ".join(keys).split() if k % 2 else []), "tail", *(body[: rng.randrange(9)])]), "a"))
    docs = table(spark, rows)
    index = licenses.TemplateIndex(*licenses.word_frequencies(docs))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    some = 0
    for doc_id, text, _ in rows:
        want = brute_matches(index, text.split())
        found = {(m["label"], m["start"]): m["coverage"] for m in got[doc_id]["matches"]}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
        labels = {label for label, _ in want} | {label for phrase, label in licenses.BASE if f" {phrase} " in f" {text} "}
        assert got[doc_id]["labels"] == ",".join(sorted(labels))
        assert abs(got[doc_id]["score"] - (1 if got[doc_id]["n_base"] else max(want.values(), default=0))) < 1e-9
        some += 0 < len(want)
    assert 30 < some < len(rows)


# classifiers


def _held_out(spark, small, name, modulus, kept, column):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, small).collect()}
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == kept) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    return sum(got[i]["predicted"] == labels[i] for i in held) / len(held)


def test_quality_held_out_accuracy(spark):
    assert _held_out(spark, "/root/testdata/sf0.01", "op2_quality_classifier", 3, 1, "quality") >= 0.95


def test_toxicity_held_out_accuracy(spark):
    assert _held_out(spark, "/root/testdata/sf0.01", "op10_toxicity", 5, 0, "toxic") >= 0.9


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_classifiers_without_labels_and_on_odd_rows(spark, odd, none, kind):
    labels = spark.createDataFrame([(4, 1), (5, None)], "doc_id long, label int")
    if kind == "quality":
        for rows in (odd, none):
            assert quality.score_quality(rows, quality.fit(rows, labels.limit(0))).count() == rows.count()
        assert {r["score"] for r in quality.score_quality(odd, quality.fit(odd, labels)).collect()} == {1.0}
        both = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (1, 0), (99, 1)], "doc_id long, label int")
        assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, quality.fit(odd, both)).collect())
        assert quality.keep_good(odd, 1.0).columns == odd.columns and quality.keep_good(odd, 1.0).count() == 9 and quality.keep_good(odd, 0.0).count() == 0
    else:
        for rows in (odd, none):
            costs = deobfuscate.language_model(toxicity.corpus_trigrams(rows))
            assert toxicity.score_toxicity(rows, costs, toxicity.fit(rows, labels.limit(0), costs)).count() == rows.count()
            assert toxicity.restored_texts(rows, costs).count() == rows.count()
        both = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (1, 0)], "doc_id long, label int")
        lexicon = toxicity.fit(odd, both, costs)
        assert toxicity.keep_civil(odd, costs, lexicon).columns == odd.columns
        assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, costs, lexicon).collect())


def test_attention_learns_which_passage_matters():
    import numpy as np

    rng = np.random.default_rng(2)
    bags, y = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(2, 8), 20)).astype(np.float32)
        bag[:, 0] = 0
        if i % 2:
            bag[rng.integers(len(bag)), 0] = 4.0  # one telling passage
        bags.append(bag)
        y.append(i % 2)
    model = quality.train(bags[:200], np.array(y[:200], float))
    offs = np.concatenate([[0], np.cumsum([len(b) for b in bags[200:]])])
    score = model.score(np.concatenate(bags[200:]), offs)
    assert ((score >= 0.5) == np.array(y[200:])).mean() > 0.9
    again = quality.train(bags[:200], np.array(y[:200], float))
    assert all((model.weights[k] == again.weights[k]).all() for k in model.weights)


def test_gradients_are_those_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    offs, y = np.array([0, 2, 5]), np.array([1.0, 0.0])
    x = rng.normal(size=(5, 4))
    w = {"W": rng.normal(size=(4, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}
    loss = lambda: float(-np.mean(y * np.log(p := quality._forward(w, x, offs)[0]) + (1 - y) * np.log(1 - p)))
    grads = quality._gradients(w, x, offs, y)
    for k, v in w.items():
        at = tuple(0 for _ in v.shape)
        keep = v[at]
        v[at] = keep + 1e-6
        up = loss()
        v[at] = keep - 1e-6
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6


def test_disguises_are_restored(spark):
    words = "you are an idiot and a moron the stupid clown is pathetic trash scum loser people in on of to with for "
    docs = table(spark, [(i, words * 30, "a") for i in range(5)])
    restorer = deobfuscate.Restorer(deobfuscate.language_model(toxicity.corpus_trigrams(docs)))
    for put, want in {"m0r0n": "moron", "s t u p i d": "stupid", "cl0wn": "clown", "STUUUPID": "stupid", "tr@sh": "trash", "l-o-s-e-r": "loser", "$cum": "scum", "id!ot": "idiot"}.items():
        assert restorer.restore(f"the {put} people") == f"the {want} people"
    plain = "the people, 12 of 30 are on-line: a@b.example.com!!! costs $$$ 5.00 — née Ünal"
    assert restorer.restore(plain) == plain.lower().replace("ü", "ü") or restorer.restore(plain).count(" ") == plain.count(" ")
    assert restorer.restore("") == "" and restorer.restore(LONG) == LONG


def test_long_disguises_and_long_separators_are_restored(spark):
    words = "you are an idiot and a moron the stupid clown is pathetic trash scum loser people in on of to with for "
    docs = table(spark, [(i, words * 30, "a") for i in range(5)])
    restorer = deobfuscate.Restorer(deobfuscate.language_model(toxicity.corpus_trigrams(docs)))
    for put, want in {"st" + "u" * 60 + "pid": "stupid", "i..d..i..o..t": "idiot", "s  t  u  p  i  d": "stupid", "l\no\ns\ne\nr": "loser", "st--up..id": "stupid"}.items():
        assert restorer.restore(f"the {put} people") == f"the {want} people"
    phrase = "you are a stupid idiot and a pathetic loser and a moron"
    chains = {"-".join(phrase.replace(" ", "")): "stupid idiot loser moron", "people/in/on/of/to/with/for/the/people/m0r0n/people/in/on/of": "moron", "people-in-on-of-to-with-for-the-people-of-the-m0r0n-people": "moron"}
    chains |= {"这是一个很长的句子没有任何空格s.t.u.p.i.d这是一个很长的句子": "stupid", "これはとてもながいぶんですm0r0nこれはとてもながい": "moron", "ประโยคภาษาไทยที่ยาวมากcl0wnประโยคภาษาไทย": "clown"}
    for put, want in chains.items():
        raw = deobfuscate.tk.LOWER[np.frombuffer(f"the {put} people".encode(), np.uint8)]
        scored = restorer.texts(raw, np.array([0, len(raw)]), rivals=True)[0].tobytes().decode()
        assert set(want.split()) <= set(re.findall("[a-z]+", scored)) and scored.isprintable()
        assert not set(want.split()) & set(re.findall("[a-z]+", put))
        assert restorer.restore(f"the {put} people").startswith("the ") and len(restorer.restore(put)) <= len(put)


def whole_lattice(token, costs):
    """The best text over a whole token with every choice of its characters, by the costs the module states; afresh behind hard characters."""
    soft = set("abcdefghijklmnopqrstuvwxyz") | set(deobfuscate.LOOKALIKES) | set(deobfuscate.SEPARATORS)
    paths = {(0, 0): (0.0, "")}
    units = [m[0] for m in re.finditer(r"[-._'~]+|(.)\1*", token)]
    for k, unit in enumerate(units):
        if unit[0] not in soft:
            best = min((cost + costs[a][b][0], text) for (a, b), (cost, text) in paths.items())
            paths = {(0, 0): (best[0], best[1] + unit)}
            continue
        inside = 0 < k < len(units) - 1 and units[k - 1][0] in soft and units[k + 1][0] in soft
        c, n = unit[0], len(unit)
        if c.isalpha():
            choices = [(unit, 0.0, [ord(c) - 96] * n)] + [(c * m, 0.5, [ord(c) - 96] * m) for m in (1, 2) if n >= 3]
        else:
            letters = deobfuscate.LOOKALIKES.get(c, "") if n == 1 or n == 2 and c in "$0!|@" else ""
            choices = [(unit, 6.5 if letters else 0.0, [0])] + [(x * n, 2.5 if c == "*" else 1.0 * n, [ord(x) - 96] * n) for x in letters]
            if c in deobfuscate.SEPARATORS and inside:
                choices.append(("", 1.2, []))
        ahead = {}
        for (p, q), (cost, text) in paths.items():
            for out, price, symbols in choices:
                a, b, more = p, q, cost + price
                for s in symbols:
                    more, a, b = more + costs[a][b][s], b, s
                if (a, b) not in ahead or more < ahead[a, b][0]:
                    ahead[a, b] = (more, text + out)
        paths = ahead
    return min((cost + costs[a][b][0], text) for (a, b), (cost, text) in paths.items())[1]


def test_chains_of_any_length_are_read_by_one_lattice(spark):
    words = "you are an idiot and a moron the stupid clown is pathetic trash scum loser people in on of to with for that admin hate"
    docs = table(spark, [(i, f"{words} " * 30, "a") for i in range(5)])
    costs = deobfuscate.language_model(toxicity.corpus_trigrams(docs))
    restorer = deobfuscate.Restorer(costs)
    rng = random.Random(8)
    disguise = lambda w: "".join(rng.choice({"o": "0", "i": "1!", "e": "3", "a": "4@", "s": "5$"}.get(c, c) + c) for c in w)
    changed = 0
    for n in range(300):
        chain, size = "", rng.randint(20, 400)
        while len(chain) < size:
            word = rng.choice(words.split())
            chain += (disguise(word) if rng.random() < 0.5 else word) + rng.choice("/,:;=&-._")
        chain = chain.rstrip("-._")
        raw = np.frombuffer(chain.encode(), np.uint8)
        want, at = "", 0
        for a, b in deobfuscate.suspects(raw, np.array([0, len(raw)])):
            want += chain[at:a] + whole_lattice(chain[a:b], costs)
            at = b
        want += chain[at:]
        assert restorer.restore(chain) == want == restorer.restore(f"{'people/' * (n % 40)}{chain}")[7 * (n % 40) :]
        changed += want != chain
    assert changed > 250
    for lead in ("", "a" * 3 + "/", "people/" * 30, "people-of-" * 30):
        got = restorer.restore(f"{lead}the/1d10t/in/that/4dm1n/h4te/3rr/0nly")
        assert got.endswith("the/idiot/in/that/admin/hate/" + got.rsplit("hate/", 1)[1]) and whole_lattice("4dm1n", costs) == "admin"


def test_tokens_end_where_nothing_can_hide():
    cut = lambda t: [t.encode()[a:b].decode() for a, b in zip(*deobfuscate.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])), strict=True)]
    assert cut("the/1d10t,4dm1n b.c") == ["the", "1d10t", "4dm1n", "b.c"]
    assert cut("\u4f60\u597dm0r0n\u4f60.\u597d.x.\u4f60") == ["\u4f60\u597d", "m0r0n", "\u4f60.\u597d", ".x.", "\u4f60"]
    assert cut("") == [] and cut("  /2") == []


def test_the_sample_is_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * (i * 10)) for i in range(1, 30)] + [(90, 1, None), (91, 0, "y" * 5000)], "doc_id long, label int, text string")
    got = common.within_bytes(rows, 800).collect()
    assert sum(len(r["text"] or "") for r in got) <= 800 and 90 in {r["doc_id"] for r in got} and all(len(r["text"] or "") <= 100 for r in got)
    assert sorted(r["doc_id"] for r in common.within_bytes(rows.repartition(5), 800).collect()) == sorted(r["doc_id"] for r in got)
    assert common.within_bytes(rows, 10**6).count() == 31 and common.within_bytes(rows.limit(0), 800).count() == 0


def test_disguised_words_count_as_the_words(spark):
    clean = "the people of the town with an old house for rent on that street are kind "
    rng = random.Random(2)
    filler = lambda: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(40)) + " "
    rows = [(i, filler() + clean + (f"{('moron', 'stupid')[i // 4 % 2]} w{i}" if i % 4 == 0 else f"fine w{i}"), "a") for i in range(200)]
    rows += [(900, clean + "m0r0n here", "a"), (901, clean + "s t u p i d here", "a"), (902, clean, "a")]
    docs = table(spark, rows)
    costs = deobfuscate.language_model(toxicity.corpus_trigrams(docs))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, costs, toxicity.fit(docs, labels, costs)).collect()}
    assert got[900] >= 0.5 and got[901] >= 0.5 and got[902] < 0.5 and got[1] < 0.5 and got[4] >= 0.5


def test_rare_toxic_words_are_learned_beside_many_common_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CANDIDATES", 50, raising=False)
    common = " ".join(f"{a}{b}lo" for a in "bcdfghklmn" for b in "aeiou")
    rare = ("moronic", "vermin")
    own = lambda i: " ".join(f"n{i}x{k}" for k in range(200))
    rows = [(i, f"{common} {own(i)} {rare[i // 4 % 2] if i % 4 == 0 else ''}", "a") for i in range(80)] + [(900 + k, f"a {w} here", "a") for k, w in enumerate(rare)] + [(990, common, "a")]
    docs = table(spark, rows)
    costs = deobfuscate.language_model(toxicity.corpus_trigrams(docs))
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, label int"), costs)
    assert {deobfuscate.tk.hash_word(w) for w in rare} <= set(lexicon.hashes.tolist())
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, costs, lexicon).collect()}
    assert min(got[900], got[901]) > got[990]


def test_training_rows_of_conflicting_labels_and_texts(spark):
    docs = table(spark, [(1, "b", "a"), (1, "a", "b"), (2, None, "a"), (2, None, "a"), (3, "c", "a"), (None, "d", "a"), (5, "e", "a")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (3, 7), (4, 1), (None, 1), (5, 1)], "doc_id long, label int")
    for rows in (docs, docs.orderBy(F.desc("text")).repartition(5)):
        got = common.training_rows(rows, labels.repartition(3), 10).collect()
        assert sorted(map(tuple, got)) == [(1, 1, "a"), (2, 0, None), (5, 1, "e")]
    # documents that are not there use up nothing of the sample
    assert common.training_rows(docs, labels, 3).count() == 3


def test_long_texts_are_scored_by_passages_of_the_same_size():
    import pyarrow as pa

    text = "Some words, 12 of them; then others. " * 20_000
    (_, _, features, offs), = quality.passages(pa.array([text]))
    assert offs.tolist() == [0, -(-len(text) // 512)] and (np.expm1(features[:-1, -1] * 5) < 150).all()
    (_, _, short, _), = quality.passages(pa.array([text[: 512 * 50]]))
    same = np.ones(features.shape[1], bool)
    same[-4] = False  # words seen before, over the whole text
    assert np.allclose(features[1:49, same], short[1:49, same])


def test_many_rows_without_id_are_mixed_by_their_texts(spark):
    rows = [(None, f"w{i} " * (i % 7 + 1), "a") for i in range(2000)] + [(i, "x y z", "b") for i in range(500)]
    docs = table(spark, rows)
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"]) and all(r["taken"] <= 3 * r["size"] for r in mine)
    keys = docs.filter("doc_id IS NULL").select(F.md5(F.md5("text")).alias("k")).select(F.substring("k", 1, mixing.RANGE_DIGITS)).distinct().count()
    assert keys > 1000  # not one range

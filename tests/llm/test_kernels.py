from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from labelscope.llm import textkernel as tk
from labelscope.llm.components import connected_components, smallest_reachable
from labelscope.llm.fm_index import FMIndex, suffix_array

TEXTS = ["", "a", "Ab c", "  x  ", "dé\tFG\x0bh 12", "a b c d e f", None, "ß-ß", "日本 語", "a" * 300]


@pytest.mark.parametrize(("member", "pattern"), [(tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tk.NONSPACE, r"[^\x20\x09-\x0D]+")])
def test_words_equal_the_patterns(member, pattern):
    raw, offs = tk.buffers(pa.array(TEXTS))
    raw = tk.LOWER[raw]
    starts, ends, woffs = tk.word_spans(raw, offs, member)
    words = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    for i, text in enumerate(TEXTS):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        assert words[woffs[i] : woffs[i + 1]] == re.findall(pattern, lowered)


def test_hashes_are_a_function_of_the_word_alone():
    raw, offs = tk.buffers(pa.array(["foo bar foo", "bar", "xx foo"]))
    starts, ends, _ = tk.word_spans(raw, offs, tk.NONSPACE)
    h = tk.word_hashes(raw, starts, ends)
    assert h[0] == h[2] == h[5] == tk.hash_word("foo") and h[1] == h[3] != h[0]


def test_slices_hold_whole_texts():
    raw, offs = tk.buffers(pa.array(["ab", "", "cdefgh", "i"]))
    got = [(lo, hi, part.tobytes()) for lo, hi, part, _ in tk.slices(raw, offs, 3)]
    assert b"".join(g[2] for g in got) == b"abcdefghi" and got[0][0] == 0 and got[-1][1] == 4
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_shingles_of_short_and_long_texts():
    texts = ["", "a b", "a b c d e", "a b c d e f", "b a"]
    raw, offs = tk.buffers(pa.array(texts))
    starts, ends, woffs = tk.word_spans(raw, offs, tk.NONSPACE)
    sh, so = tk.shingles(tk.word_hashes(raw, starts, ends), woffs)
    assert np.diff(so).tolist() == [0, 1, 1, 2, 1] and sh[so[2]] == sh[so[3]] and sh[so[1]] != sh[so[4]]


def test_vocabulary_ids():
    v = tk.Vocabulary(["the", "of", "zürich"])
    raw, offs = tk.buffers(pa.array(["the x of zürich"]))
    starts, ends, _ = tk.word_spans(raw, offs, tk.ALNUM)
    assert v.ids(tk.word_hashes(raw, starts, ends)).tolist() == [0, -1, 1, 2]
    assert tk.Vocabulary([]).ids(np.array([1], np.uint64)).tolist() == [-1]


def test_suffix_array_and_search_against_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        text = []
        for _ in range(rng.randint(1, 8)):
            text += [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        t = np.array(text)
        keyed = [(-1, i) if s == 0 else (s, 0) for i, s in enumerate(text)]
        assert suffix_array(t).tolist() == sorted(range(len(text)), key=lambda i: keyed[i:])
        index = FMIndex(t, 3)
        for size in (1, 2, 5):
            patterns = np.array([[rng.randint(1, 3) for _ in range(size)] for _ in range(10)])
            low, high = index.search(patterns)
            for p, a, b in zip(patterns.tolist(), low, high, strict=True):
                want = [i for i in range(len(text) - size + 1) if text[i : i + size] == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_smallest_reachable():
    node, low = smallest_reachable(np.array([5, 7, 9, 2]), np.array([7, 9, 1, 3]))
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 3: 2}


def test_components_over_many_partitions_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5050)]
    df = spark.createDataFrame(edges, "a long, b long")
    node, low = smallest_reachable(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    want = {n: m for n, m in zip(node.tolist(), low.tolist(), strict=True) if n != m}
    for size in (10_000, 25):
        assert {r["node"]: r["component"] for r in connected_components(df, size).collect()} == want


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

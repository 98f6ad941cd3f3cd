"""Conversation repair against enumeration of all edits, packing against the library, bounds and exhaustive packing."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from labelscope.llm import bpe_ids, packing, turn_repair
from labelscope.llm.queries import ORACLE, QUERIES

# ---- op11


def cheapest(rows):
    """(cost, audit, initials) by trying all edits, at most two insertions in a row."""
    seen, faults = set(), []
    for row in rows:
        bare = row[1].strip(turn_repair.SPACE)
        faults.append("gone" if not bare or row in seen else "short" if bare[-1] not in ".!?" else "")
        seen.add(row)
    best = None

    def go(i, cost, audit, initials, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit, initials) < best):
            best = (cost, audit, initials)
        if inserted < 2:
            for name in "ua":
                go(i, cost + 3, audit + "I", initials + name, inserted + 1)
        if i == len(rows):
            return
        go(i + 1, cost + 4, audit + "D", initials, 0)
        if faults[i] != "gone":
            more = 3 * (faults[i] == "short")
            go(i + 1, cost + more, audit + "K", initials + rows[i][0][:1], 0)
            for name in "ua":
                go(i + 1, cost + more + 3, audit + "R", initials + name, 0)

    go(0, 0, "", "", 0)
    return best


def test_repair_equals_all_edits():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b?", "c", "", " e!", "f", "g."])) for _ in range(rng.randrange(4))]
        cost, audit, left = turn_repair.repair_rows(rows)
        assert (cost, audit, "".join(r[:1] for r, _ in left)) == cheapest(rows)


def test_blocks_give_the_path_of_the_whole():
    rng = random.Random(6)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.randrange(4)) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(4))})
        blocks = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        behind = [list(turn_repair.ENDING)]
        for block in reversed(blocks):
            behind.append(turn_repair.carried(turn_repair.block_costs(block), behind[-1]))
        behind.reverse()
        state, edits, cost = 0, "", 0
        for block, after in zip(blocks, behind[1:], strict=True):
            more, state, spent = turn_repair.Trace(block, after).edits(state)
            edits, cost = edits + more, cost + spent
        assert (edits, state, cost) == turn_repair.Trace(rows, list(turn_repair.ENDING)).edits(0)


ROWS = "conv_id long, turn long, role string, text string"


def expected(rows):
    """Summaries of conversations by ``repair_rows`` on whole, sorted conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " "))
        pairs = [(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in mine]
        cost, audit, left = turn_repair.repair_rows(pairs)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def test_summaries_of_long_null_and_repeated_rows(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["system", "user", "assistant"]), rng.choice(["x.", "y", "", f"{t}.", f"{t}?"])) for t in range(300)]
    rows += [(2, None, None, None), (2, 0, "user", "hi."), (2, 0, "user", "hi."), (None, 3, "user", "a."), (None, 3, "user", "b."), (3, 0, "", "c."), (4, 0, "assistant", "long. " * 50000 + "!")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS block", "2 AS cost").repartition(5)
    for turns, octets in ((3, 1 << 20), (128, 1 << 20), (50, 10)):
        got = {r["conv_id"]: (r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in turn_repair.summaries(turn_repair.repair(df, turns, octets)).collect()}
        assert got == expected(rows)


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame([(1, k, "user", f"{k}.") for k in range(5)], ROWS)
    turns = turn_repair.repaired_turns(turn_repair.repair(df, 2)).orderBy("block", "place").collect()
    assert re.fullmatch("(ua)*u?", "".join(t["role"][0] for t in turns))


def test_empty_table_and_gaps(spark):
    empty = spark.createDataFrame([], ROWS)
    assert turn_repair.summaries(turn_repair.repair(empty)).count() == 0
    rows = [(1, 0), (1, 5), (1, 5), (1, None), (2, None)]
    gaps = turn_repair.turn_gaps(spark.createDataFrame(rows, "conv_id long, turn long"))
    assert {r["conv_id"]: r["gaps"] for r in gaps.collect()} == {1: 4, 2: 0}


def test_op11_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, rng.choice([t, t, t + 2, None]), rng.choice(["system", "user", "assistant", None]), rng.choice([f"a{t}.", "same?", None, "no end", " "])) for c in [*range(60), None] for t in range(rng.randrange(1, 7))]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op11_turn_repair"](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(ORACLE["op11_turn_repair"]).df()
    key = lambda frame: sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False)))
    assert key(got.astype({"conv_id": "Int64"})) == key(want.astype({"conv_id": "Int64"})) and len(got) == 61


# ---- op12


@pytest.fixture(scope="module")
def encoder():
    return bpe_ids.Ids(open(bpe_ids.vocabulary_path(), encoding="utf-8").read(), bpe_ids.unsure_characters())


def test_ids_are_the_librarys(encoder):
    rng = random.Random(9)
    alphabet = "ab Z9'.,\n\t\r\x0b\x1c\x85\xa0 　éß中ไ한०²Ⅷ_-<|>\U0001f600́͸"
    texts = ["", " ", "  a  b ", "it's 'll don'T", "x<|endoftext|>y <|endoftext|>", "a" * 5000, " " * 5000 + "b", "\n" * 3000, "ab" * 3000 + " c"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(40)) for _ in range(500)]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_cut_from_the_end():
    for n, capacity in itertools.product(range(1, 40), (1, 4, 7)):
        found = packing.pieces_of(n, capacity)
        assert sum(size for _, size in found) == n and all(size == capacity for _, size in found[1:]) and 1 <= found[0][1] <= capacity
        assert [start for start, _ in found] == list(itertools.accumulate([0, *(size for _, size in found)]))[:-1]


def fewest(lengths, capacity):
    """Fewest sequences by trying all ways."""
    best = len(lengths)

    def go(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= capacity:
                go(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
        go(i + 1, [*fills, lengths[i]])

    go(0, [])
    return best


def test_bound_and_evolved_packings_on_small_cases():
    rng = random.Random(10)
    met = 0
    for seed in range(60):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        array, least = np.array(lengths, np.int64), fewest(lengths, 20)
        assert packing.least_bins(array, 20) <= least
        people = packing.evolve(array, [], 20, seed)
        for bins in people:
            assert np.bincount(bins, array).max() <= 20 and set(bins.tolist()) == set(range(bins.max() + 1))
        met += int(people[0].max()) + 1 == least
    assert met == 60


def test_crossover_keeps_injected_sequences_whole():
    rng = np.random.default_rng(11)
    lengths = np.sort(rng.integers(1, 1025, 500))[::-1].astype(np.int64)
    first, second = packing.packed(lengths, np.argsort(-lengths, kind="stable"), 1024), packing.packed(lengths, rng.permutation(500), 1024)
    taken = second < 40
    injected = np.where(taken, second, -1)
    gone = np.zeros(first.max() + 1, bool)
    gone[first[taken]] = True
    child = packing.repacked(lengths, first, gone, injected, 1024)
    for b in range(40):
        assert len(set(child[second == b].tolist())) == 1
    assert np.bincount(child, lengths).max() <= 1024 and len(child) == 500
    better = packing.evolve(lengths, [first, second], 1024, 3, offspring=30)
    assert packing.fitness(lengths, better[0], 1024) <= min(packing.fitness(lengths, p, 1024) for p in (first, second))


def test_pack_is_valid_and_near_the_bound(spark, encoder):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "naïve", "数据"]) for _ in range(rng.randrange(0, 160))) for _ in range(400)] + [None, "", "z " * 9000, "same text here", "same text here"]
    rows = [(None if k == 7 else k % 390, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(df, 128, 100).toPandas()
    wanted = []
    for doc, text, _ in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for piece, (start, size) in enumerate(packing.pieces_of(len(ids), 128)):
            wanted.append((-1 if doc is None else doc, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
    found = got.assign(doc_id=got["doc_id"].fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(found.itertuples(index=False, name=None)) == sorted(wanted)
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 128
    lengths = np.sort(got["length"].to_numpy())[::-1].astype(np.int64)
    assert got["sequence_id"].nunique() <= packing.packed(lengths, np.arange(len(lengths)), 128).max() + 2  # best fit over all at once, and one


def test_hot_lengths_and_empty_tables(spark):
    short = spark.range(3000).selectExpr("id AS item", "CAST(CASE WHEN id % 3 = 0 THEN 600 WHEN id % 3 = 1 THEN 424 ELSE 1 END AS int) AS length")
    placed = packing.pack_short(short, 1024, 500)
    assert placed.count() == 3000 and 1001 <= placed.select("sequence_id").distinct().count() <= 1004
    ones = spark.range(1000).selectExpr("id AS item", "1 AS length")
    assert packing.pack_short(ones, 2000, 400).count() == 1000  # shards of one sequence each
    assert packing.pack_short(short.limit(0)).count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0

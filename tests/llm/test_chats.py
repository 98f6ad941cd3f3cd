from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from labelscope.llm import chat_format as C
from labelscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, block long, scores string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def best_path(model, lines):
    """Scores of every assignment of (role, begins) to the lines, the best one first."""
    best, found = -np.inf, None
    for path in itertools.product([(r, b) for r in range(3) for b in (True, False)], repeat=len(lines)):
        before, score = C.START, 0.0
        for (_, marked, shape, first), (role, begins) in zip(lines, path, strict=True):
            if begins:
                score += model.follow[before][role] + model.begin(marked, shape, first)[role]
            elif first or role != before:
                score = -np.inf
                break
            else:
                score += model.inside(marked, shape)[role]
            before = role
        if score > best:
            best, found = score, list(path)
    return found


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(5)
    for _ in range(25):
        model = C.Model({("follow", a, b): rng.randint(0, 30) for a in range(4) for b in range(3)} | {("shape", r, s): rng.randint(0, 30) for r in range(3) for s in range(C.N_SHAPES)})
        rows = [C.lines_of(rng.choice(["user", "assistant", None, "system"]), rng.choice(["hi?", "User: a\nb", "x\nBot: y", "long " * 30])) for _ in range(3)]
        rows = rows[: 2 if sum(map(len, rows)) > 5 else 3]
        flat = [x for r in rows for x in r]
        got = [x for r in C.decode_block(model, rows, C.START) for x in r]
        assert got == best_path(model, flat)


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_blocks_give_the_path_of_the_whole_conversation(spark, block):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, None]), rng.choice(["why?", "I think so. " * 20, "ok\nUser: really?\nthen", "a"])))
    got = sorted(tuple(r)[:5] for r in C.format_chats(table(spark, rows), block).collect())
    want = sorted(tuple(r)[:5] for r in C.format_chats(table(spark, rows), 10_000).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    if block > 3:
        assert got == want
    # counts too are those of whole conversations
    model, again = (C.learn(C.blocks_of(table(spark, rows), n)) for n in (block, 10_000))
    assert model.follow == again.follow and model.shape == again.shape
    # with the same model, blocks of one turn give the same path
    model = C.Model({("follow", 1, 2): 9, ("follow", 2, 1): 9, ("follow", 3, 1): 9})
    lines = [C.lines_of(r[2], r[3]) for r in rows if r[0] == 0]
    whole = C.decode_block(model, lines, C.START)
    scores, backs = np.array([-np.inf] * 3 + [0.0]), []
    for row in lines:
        total = scores[:, None] + C.block_scores(model, [row])
        backs.append(total.argmax(0))
        scores = np.append(total.max(0), -np.inf)
    role, ends = int(np.argmax(scores[:3])), []
    for back in reversed(backs):
        ends.append((int(back[role]), role))
        role = int(back[role])
    parts = [C.decode_block(model, [row], enter, leave)[0] for row, (enter, leave) in zip(lines, reversed(ends), strict=True)]
    assert parts == whole


def test_missing_and_wrong_roles_are_recovered(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "is it so?" if t % 2 == 0 else "It is as you say. " * 20) for c in range(60) for t in range(6)]
    hidden = [(c, t, None if (c + t) % 5 == 0 else r, x) for c, t, r, x in rows]
    got = {(r["conv_id"], r["turn"]): r["role"] for r in C.format_chats(table(spark, hidden)).collect()}
    assert all(got[c, t] == r for c, t, r, _ in rows)
    other = [(c, t, {"user": "Human", "assistant": "GPT"}[r], x) for c, t, r, x in rows]
    assert all(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in C.format_chats(table(spark, other)).collect())


def test_markers_in_texts_split_turns():
    assert C.parse_transcript("System: be nice\nUser: hi?\nmore\n\n**Assistant:** hello\n[user] bye\n### Response\nok") == [
        ("system", "be nice"), ("user", "hi?\nmore"), ("assistant", "hello"), ("user", "bye"), ("assistant", "ok"),
    ]
    assert C.parse_transcript("") == C.parse_transcript("") and len(C.parse_transcript("no speaker\nat all")) == 1


def test_lines_that_go_on_keep_what_looks_like_a_marker(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "is it so?" if t % 2 == 0 else "It is as you say.") for c in range(60) for t in range(6)]
    rows += [(100, 0, "user", "how much?"), (100, 1, "assistant", "Work: 6*7\nAnswer: 42"), (100, 2, "user", "which one is it?"), (100, 3, "assistant", "User: what a word")]
    got = [(r["turn"], r["role"], r["text"]) for r in C.format_chats(table(spark, rows)).collect() if r["conv_id"] == 100]
    assert sorted(got)[:2] == [(0, "user", "how much?"), (1, "assistant", "Work: 6*7\nAnswer: 42")]
    assert "".join(x for t, _, x in sorted(got) if t == 1) == "Work: 6*7\nAnswer: 42"
    # the row's role counts beside the marker of its first line
    assert (3, "assistant", "User: what a word") in got


def test_rendering_and_round_trip(spark):
    turns = [("system", "Rules."), ("user", "Q one?\n\nwith a gap"), ("assistant", "Yes")]
    text = "".join(C.render(r, t) for r, t in turns)
    again = C.parse_transcript(text.replace("<|end|>\n", ""))
    assert again == turns


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "late"), (None, 3, "user", "a"), (2, 0, "???", ""), (3, 10**12, "assistant", "x" * 200_000), (3, -5, "user", "neg")]
    got = [(r["conv_id"], r["turn"], r["text"]) for r in C.format_chats(table(spark, rows)).collect()]
    assert len(got) == 7 and got.count((1, 0, "")) == 2 and (1, None, "late") in got and (None, 3, "a") in got and (2, 0, "") in got and (3, -5, "neg") in got
    assert C.format_chats(table(spark, [])).count() == 0


def test_query_equals_sql(spark, small):
    import duckdb
    from labelscope.llm.queries import ORACLE

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    key = ["conv_id", "turn", "part", "role", "text", "rendered"]
    got = sorted(map(tuple, QUERIES["op5_chat_format"](spark, small).toPandas()[key].values.tolist()))
    assert got == sorted(map(tuple, c.execute(ORACLE["op5_chat_format"]).df()[key].values.tolist())) and got


def test_hot_turns_and_conversations_are_dealt_over_tasks(spark):
    rng = random.Random(9)
    rows = [(1, None, rng.choice(["user", "assistant"]), f"text {rng.randrange(10**6)}") for _ in range(3000)]
    rows += [(1, 7, "user", "the same") for _ in range(2000)] + [(None, None, "assistant", None) for _ in range(1500)] + [(2, 0, "user", "q?"), (2, 1, "assistant", "a")]
    got = C.format_chats(table(spark, rows), 64)
    found = got.collect()
    assert len(found) == len(rows) and {r["part"] for r in found} == {0}
    whole = C.format_chats(table(spark, rows), 10**6).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, whole))
    place = C.F.spark_partition_id()
    spread = got.select(place.alias("p"), "conv_id", "turn").groupBy("p").count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 0.5 * len(rows)

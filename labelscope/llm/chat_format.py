"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

Rows of a conversation are read line by line. A line's observations are the speaker marker
it has (such as ``User:`` or ``### Answer`` at its start), the row's role on its first line, its length and whether it asks. States are a role beginning a turn or going
on with it. Transitions and line statistics are counted over all rows whose role is
known; markers are trusted but may be wrong or missing.

A conversation is decoded by Viterbi in blocks of turns: each block is first reduced to
the best scores between the role before it and the role at its end (3 numbers for each
role before), these are chained along the conversation, and the blocks are then
decoded between known ends. So a very long conversation is spread over many tasks, and
the paths are those of the whole conversation. Every path of a turn ends with its row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.llm.common import bound_batches, cut, released, table

ROLES = ("system", "user", "assistant")
START = 3
BLOCK_TURNS = 256
#: Characters of a text that order rows of one turn and role.
TEXT_ORDER = 32

#: What speakers are called.
NAMES = {
    "system": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "prompter": 1, "customer": 1, "instruction": 1, "prompt": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "chatbot": 2, "answer": 2, "a": 2, "response": 2, "agent": 2, "chatgpt": 2,
}
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
#: "User:", "**User**:", "[user]", "### User", "<|user|>", "> Human:" at the start of a line.
MARKER = re.compile(rf"\s*(?:(?:>\s*)?(?:\*\*|__)?({_NAME})(?:\*\*|__)?\s*:(?:\*\*|__)?|\[({_NAME})\]:?|#{{1,6}}\s*({_NAME})\s*:?\s*$|<\|({_NAME})\|>)[ \t]*", re.I)

#: Chances of a marker: right on a beginning line, none on one, another's; on a line that goes on.
MARKED, UNMARKED_ROW, UNMARKED_LINE, STRAY = 0.95, 0.2, 1e-4, 0.02
LENGTHS = (1, 60, 160, 400)
N_SHAPES = 2 * (len(LENGTHS) + 1)


def role_of(name: str | None) -> int:
    """Number of the role a name stands for, -1 if it is none."""
    return NAMES.get(re.sub(r"[^a-z]", "", (name or "").lower()), -1)


def shape_of(line: str) -> int:
    size = sum(len(line) >= n for n in LENGTHS)
    return 2 * size + line.rstrip().endswith("?")


def lines_of(role: str | None, text: str | None) -> list[tuple]:
    """Lines of a row: ((line, line without its marker, marker's role), what is observed, shape, whether it begins the row).

    Observed is the marker's role, -1 for none; on the row's first line both the row's own and the marker's.
    """
    out = []
    for k, line in enumerate((text or "").split("\n")):
        found = MARKER.match(line)
        marked = role_of(next(g for g in found.groups() if g)) if found else -1
        bare = line[found.end() :] if found else line
        out.append(((line, bare, marked), marked if k else (role_of(role), marked), shape_of(bare), k == 0))
    return out


class Model:
    """Log chances of roles following roles (START first) and of line shapes, from counts."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        follow, shape = np.ones((4, 3)), np.ones((3, N_SHAPES))
        for (kind, a, b), n in counts.items():
            (follow if kind == "follow" else shape)[a, b] += n
        self.follow = np.log(follow / follow.sum(1, keepdims=True)).tolist()
        self.shape = np.log(shape / shape.sum(1, keepdims=True)).tolist()

    def begin(self, marked, shape: int, first: bool) -> list[float]:
        """Cost-free scores of a line beginning a turn of each role; ``marked`` as in ``lines_of``."""
        seen = [m for m in (marked if first else (marked,)) if m >= 0]
        none = np.log(UNMARKED_ROW if first else UNMARKED_LINE)
        return [self.shape[r][shape] + (sum(np.log(MARKED if m == r else STRAY) for m in seen) if seen else none) for r in range(3)]

    def inside(self, marked: int, shape: int) -> list[float]:
        return [self.shape[r][shape] + np.log(STRAY if marked >= 0 else 1 - STRAY) for r in range(3)]


def _step(model: Model, before: list[float], line) -> tuple[list[float], list[tuple[int, bool]]]:
    """Scores by role after a line, and where each came from: (role before, whether a turn begins).

    ``before`` has the scores by role (and START) up to the line.
    """
    _, marked, shape, first = line
    opens = model.begin(marked, shape, first)
    goes = None if first else model.inside(marked, shape)
    scores, back = [], []
    for r in range(3):
        best, came = -np.inf, (0, True)
        for p, score in enumerate(before):
            value = score + model.follow[p][r] + opens[r]
            if value > best:
                best, came = value, (p, True)
        if goes is not None and before[r] + goes[r] >= best:
            best, came = before[r] + goes[r], (r, False)
        scores.append(best)
        back.append(came)
    return scores, back


def block_scores(model: Model, rows: list[list]) -> np.ndarray:
    """Best score of a block's lines for every role before it (START included) and role at its end."""
    out = np.empty((4, 3))
    for p in range(4):
        scores = [0.0 if q == p else -np.inf for q in range(4)]
        for row in rows:
            for line in row:
                scores, _ = _step(model, scores, line)
        out[p] = scores[:3]
    return out


def decode_block(model: Model, rows: list[list], enter: int, leave: int | None = None) -> list[list[tuple[int, bool]]]:
    """(role, begins) of every line of a block between the role before it and the role at its end."""
    scores = [0.0 if q == enter else -np.inf for q in range(4)]
    backs = []
    for row in rows:
        for line in row:
            scores, back = _step(model, scores, line)
            backs.append(back)
    role = int(np.argmax(scores)) if leave is None else leave
    path: list[tuple[int, bool]] = []
    for back in reversed(backs):
        before, begins = back[role]
        path.append((role, begins))
        role = before
    path.reverse()
    out, at = [], 0
    for row in rows:
        out.append(path[at : at + len(row)])
        at += len(row)
    return out


def turns_of(row: list, path: list[tuple[int, bool]]) -> list[tuple[str, str]]:
    """(role, text) of the turns of a row, white space at their ends removed; a marker goes only where it begins its role's turn."""
    turns: list[tuple[int, list[str]]] = []
    for ((line, bare, marked), *_), (role, begins) in zip(row, path, strict=True):
        if begins or not turns:
            turns.append((role, []))
        turns[-1][1].append(bare if begins and marked == role else line)
    return [(ROLES[role], "\n".join(lines).strip(" \t\r\n")) for role, lines in turns]


def parse_transcript(text: str, model: Model | None = None) -> list[tuple[str, str]]:
    """Turns of one transcript whose speakers are marked in the text."""
    rows = [lines_of(None, text)]
    return turns_of(rows[0], decode_block(model or Model({}), rows, START)[0])


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal (conv_id, block) in sorted batches, with their rows."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for row in zip(*columns, strict=True):
            if held and row[:2] != key:
                yield key, held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield key, held


_COLUMNS = ("conv_id", "block", "place", "turn", "role", "text")


def _cut_into_blocks(block_turns: int):
    """Adds block and place to the rows of a task, which are in order: a block is a run of rows of one conversation.

    Block numbers grow along the table, so those of a conversation that goes on in other tasks are in order too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1
        conv, place = None, block_turns
        for batch in batches:
            blocks, places = [], []
            for c in batch.column("conv_id").to_pylist():
                if place >= block_turns or c != conv:
                    block, conv, place = block + 1, c, 0
                blocks.append(block)
                places.append(place)
                place += 1
            columns = {"block": pa.array(blocks, pa.int64()), "place": pa.array(places, pa.int32())}
            columns |= {n: batch.column(n) for n in _COLUMNS if n not in columns}
            yield pa.RecordBatch.from_arrays([columns[n] for n in _COLUMNS], names=list(_COLUMNS))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts inside blocks, and a row for each block with the first and the last role in it."""
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("kind", "a", "b", "n", "conv_id", "block")
    counts: dict[tuple[str, int, int], int] = {}
    edges: list[tuple] = []
    for (conv, block), rows in _blocks(batches, _COLUMNS):
        numbers = [role_of(r[4]) for r in rows]
        edges.append(("edge", numbers[0], numbers[-1], 1, conv, block))
        for before, number in zip(numbers, numbers[1:], strict=False):
            if min(before, number) >= 0:
                counts["follow", before, number] = counts.get(("follow", before, number), 0) + 1
        for row, number in zip(rows, numbers, strict=True):
            for _, _, shape, _ in lines_of(row[4], row[5]) if number >= 0 else ():
                counts["shape", number, shape] = counts.get(("shape", number, shape), 0) + 1
        if len(edges) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*edges, strict=True), kinds, strict=True)], names=list(names))
            edges = []
    out = edges + [(*key, n, None, None) for key, n in counts.items()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


def learn(dealt: DataFrame) -> Model:
    """The model that the counts over all rows of ``dealt`` (blocks in order) give."""
    counted = cut(dealt.mapInArrow(released(_count), "kind string, a int, b int, n long, conv_id long, block long"))
    earlier = F.lag("b", 1, START).over(Window.partitionBy("conv_id").orderBy("block"))  # a row a block
    across = counted.filter("kind = 'edge'").select(F.lit("follow").alias("kind"), earlier.alias("a"), F.col("a").alias("b"), "n")
    every = counted.filter("kind <> 'edge'").select("kind", "a", "b", "n").unionByName(across.filter("a >= 0 AND b >= 0"))
    rows = every.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # a row for each parameter
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in rows})


def _summaries(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _blocks(batches, _COLUMNS):
            scores = block_scores(shared.value, [lines_of(r[4], r[5]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([scores.ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "block", "scores"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role before and at the end of every block of a conversation, by Viterbi over blocks."""

    def finish(conv, blocks, tables):
        scores, backs = np.array([-np.inf, -np.inf, -np.inf, 0.0]), []
        for t in tables:
            total = scores[:, None] + t.reshape(4, 3)
            back = total.argmax(0)
            backs.append(back)
            scores = np.append(total[back, np.arange(3)], -np.inf)
        role = int(np.argmax(scores[:3]))
        enter, leave = [0] * len(blocks), [0] * len(blocks)
        for k in range(len(blocks) - 1, -1, -1):
            leave[k], enter[k] = role, int(backs[k][role])
            role = enter[k]
        return pa.RecordBatch.from_arrays(
            [pa.array([conv] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32())], names=["conv_id", "block", "enter", "leave"]
        )

    conv, blocks, tables = None, [], []
    for batch in batches:
        for c, b, s in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), batch.column("scores").to_pylist(), strict=True):
            if blocks and c != conv:
                yield finish(conv, blocks, tables)
                blocks, tables = [], []
            conv = c
            blocks.append(b)
            tables.append(np.array(s))
    if blocks:
        yield finish(conv, blocks, tables)


TURNS = "conv_id long, turn long, part int, role string, text string, rendered string"


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _blocks(batches, (*_COLUMNS, "enter", "leave")):
            lines = [lines_of(r[4], r[5]) for r in rows]
            for r, row, path in zip(rows, lines, decode_block(shared.value, lines, rows[0][6], rows[0][7]), strict=True):
                out += [(r[0], r[3], part, role, text, render(role, text)) for part, (role, text) in enumerate(turns_of(row, path))]
            if len(out) > 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "part", "role", "text", "rendered"])


def blocks_of(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The rows in order, in blocks of at most ``block_turns`` of a conversation, written."""
    spark = conversations.sparkSession
    bound_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by ranges of the order, rows that are equal in all of it by their number: no conversation, turn or text is one task's
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.substring("text", 1, TEXT_ORDER), F.xxhash64("text"), F.col("number")]
    ranged = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = "conv_id long, block long, place int, turn long, role string, text string"
    return cut(ranged.drop("number").mapInArrow(released(_cut_into_blocks(block_turns)), kinds))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Canonical turns (conv_id, turn, part, role, text, rendered) of rows (conv_id, turn, role, text).

    Each row gives at least one turn; a row whose text has speakers of its own gives more,
    numbered by ``part``. ``role`` may be any name, wrong or null: then neighbours and lines
    decide. A null text is empty. Turns are in order of ``turn`` (null last), repeated ones by
    role, the first ``TEXT_ORDER`` characters of the text and a hash of it; rows without
    conv_id are one conversation. Other columns are not read; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks_of(conversations, block_turns)
    model = spark.sparkContext.broadcast(learn(dealt))
    scores = dealt.mapInArrow(released(_summaries(model)), "conv_id long, block long, scores array<double>")
    chained = scores.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(released(_chain), "conv_id long, block long, enter int, leave int")
    ends = cut(chained).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "enter", "leave")
    known = dealt.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    known = known.select(*_COLUMNS, "enter", "leave").repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    return known.mapInArrow(released(_decode(model)), TURNS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``conversations`` as canonical turns."""
    return format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: For tables whose texts have no speaker markers and whose roles are known.
OP5_SQL = r"""
SELECT conv_id, turn, CAST(0 AS INTEGER) AS part, role, trim(text, E' \t\r\n') AS text, '<|' || role || E'|>\n' || trim(text, E' \t\r\n') || E'\n<|end|>\n' AS rendered
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
"""

"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is right when the initials of its roles spell ``(s?(ua)+)?``. Rows are kept,
given another role or deleted, and empty rows inserted, each at a cost. The cheapest edits
are found by layers of cost: before every row there is a bitset of the grammar's states, one
set for each cost, from which the rows to come can be ended at exactly that cost. A row's
step shifts these sets by the costs of its edits. The first layer that holds the entered
state is the cost, and following the bits forward, least letter first, gives the least audit.

Conversations are cut into blocks of rows. A block's layers are first run for every state
at its end, which gives 4 x 4 costs; these are passed along the conversation from its end,
the states entered from its beginning, and every block is then traced on its own between
what is known. Both passes read one short row a block and hold one state, so a conversation
of any length needs no more memory than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm.common import bound_batches, cut, released, table

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Costs of ending a conversation: a user row needs an answer, a system row both.
ENDING = (0, 2 * INSERT, INSERT, 0)
ENDINGS = ((), ("user", "assistant"), ("assistant",), ())
#: Where a kept row of an initial leads, and where a row of the role that fits next leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)
SPACE = " \t\n\x0b\x0c\r"
BLOCK_TURNS = 128
BLOCK_BYTES = 1 << 20
#: Characters of a text that order rows of one turn and role.
TEXT_ORDER = 32
#: No way from one state to another.
NO_WAY = 1 << 40


def text_fault(text: str) -> int:
    """What is wrong with a row's text itself."""
    bare = text.rstrip(SPACE)
    return BLANK if not bare else CUT_SHORT if bare[-1] not in ".!?" else FINE


class Layers:
    """Bitsets of states by cost, all layers in one integer.

    ``groups`` sets of four states stand side by side in a layer, one for each end; the
    layers of a block of ``rows`` are as many as its rows may cost at most.
    """

    def __init__(self, rows: int, groups: int, spread: int = 0):
        self.width = 4 * groups
        self.count = (DELETE + INSERT) * rows + 3 * INSERT + spread + 1
        ones = ((1 << self.width * self.count) - 1) // ((1 << self.width) - 1)
        one = sum(1 << 4 * g for g in range(groups))
        self.all = (1 << self.width * self.count) - 1
        self.of = [ones * (one << s) for s in range(4)]

    def before(self, words: int, ways: dict[int, int]) -> int:
        """States from which ``ways`` lead into the states of ``words``."""
        out = 0
        for start, end in ways.items():
            held = words & self.of[end]
            out |= held >> (end - start) if end >= start else held << (start - end)
        return out

    def later(self, words: int, cost: int) -> int:
        return words << self.width * cost & self.all

    def inserted(self, words: int) -> int:
        """Up to two rows inserted before what ``words`` stand for; more of them only turn in a circle."""
        once = self.later(self.before(words, NEXT), INSERT)
        return words | once | self.later(self.before(once, NEXT), INSERT)

    def step(self, words: int, initial: str, fault: int) -> int:
        """From the sets behind a row to those before it, insertions included."""
        out = self.later(words, DELETE)
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_SHORT else 0
            out |= self.later(self.before(words, KEPT.get(initial, {})), more)
            out |= self.later(self.before(words, NEXT), REROLE + more)
        return self.inserted(out)

    def holds(self, words: int, cost: int, state: int) -> bool:
        return cost >= 0 and bool(words >> self.width * cost + state & 1)

    def least(self, words: int, bit: int) -> int:
        """The first layer with ``bit``."""
        held = words >> bit & self.of[0] // (sum(1 << 4 * g for g in range(self.width // 4)) or 1)
        return (held & -held).bit_length() // self.width if held else NO_WAY


def block_costs(rows: list[tuple[str, int]]) -> list[int]:
    """Least costs of rows (initial, fault) from every state before them to every state behind them, 16 numbers."""
    layers = Layers(len(rows), 4)
    words = sum(1 << 4 * s + s for s in range(4))
    for initial, fault in reversed(rows):
        words = layers.step(words, initial, fault)
    return [layers.least(words, 4 * end + start) for start in range(4) for end in range(4)]


def carried(costs: list[int], after: list[int]) -> list[int]:
    """Costs to the end from every state before a block, from those behind it."""
    return [min(NO_WAY, *(costs[4 * s + t] + after[t] for t in range(4))) for s in range(4)]


class Trace:
    """The layers of a block whose costs to the end are known behind it."""

    def __init__(self, rows: list[tuple[str, int]], after: list[int]):
        base = min(after)
        spread = max(a - base for a in after if a < NO_WAY)
        self.rows, self.layers = rows, Layers(len(rows), 1, spread)
        self.words = [sum(1 << 4 * (a - base) + s for s, a in enumerate(after) if a < NO_WAY)]
        for initial, fault in reversed(rows):
            self.words.append(self.layers.step(self.words[-1], initial, fault))
        self.words.reverse()

    def edits(self, state: int) -> tuple[str, int, int]:
        """Least of the cheapest edits from ``state`` before the block, the state behind it and the cost inside."""
        layers, out, spent = self.layers, [], 0
        cost = layers.least(self.words[0], state)
        for k, (initial, fault) in enumerate(self.rows):
            here, behind = self.words[k], self.words[k + 1]
            more = TRUNCATED if fault == CUT_SHORT else 0
            kept = KEPT.get(initial, {}).get(state)
            stays = fault not in (BLANK, DUPLICATE)
            while True:
                if layers.holds(behind, cost - DELETE, state):
                    letter, price = "D", DELETE
                elif layers.holds(here, cost - INSERT, NEXT[state]):
                    letter, price, state = "I", INSERT, NEXT[state]
                elif stays and kept is not None and layers.holds(behind, cost - more, kept):
                    letter, price, state = "K", more, kept
                else:
                    letter, price, state = "R", REROLE + more, NEXT[state]
                out.append(letter)
                cost, spent = cost - price, spent + price
                if letter != "I":
                    break
                kept = KEPT.get(initial, {}).get(state)
        return "".join(out), state, spent


def applied(edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the rows that ``edits`` leave, beginning in ``state``."""
    out, at = [], 0
    for letter in edits:
        if letter == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        if letter == "K":
            state = KEPT[roles[at][:1]][state]
            out.append((roles[at], texts[at]))
        elif letter == "R":
            state = NEXT[state]
            out.append((NAMES[state], texts[at]))
        at += 1
    return out


def repair_rows(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and repaired rows of a conversation (role, text) in order: the whole method on one block."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in rows:
        fault = text_fault(row[1])
        faults.append((row[0][:1], fault if fault == BLANK else DUPLICATE if row in seen else fault))
        seen.add(row)
    edits, state, cost = Trace(faults, list(ENDING)).edits(START)
    out = applied(edits, START, [r for r, _ in rows], [t for _, t in rows]) + [(n, "") for n in ENDINGS[state]]
    return cost + ENDING[state], edits + "I" * len(ENDINGS[state]), out


# ---- on Spark

_BLOCK = "conv_id long, block long, roles array<string>, texts array<string>, faults array<int>, digests array<binary>"


def _into_blocks(block_turns: int, block_bytes: int):
    """Rows of a task, which are in order, as one row for each block of a conversation."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()))
    names = ("conv_id", "block", "roles", "texts", "faults", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        conv, roles, texts, held = None, [], [], 0

        def block() -> pa.RecordBatch:
            digests = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
            values = (conv, number, roles, texts, [text_fault(t) for t in texts], digests)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=list(names))

        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if roles and (c != conv or len(roles) >= block_turns or held + len(text) > block_bytes):
                    yield block()
                    number, roles, texts, held = number + 1, [], [], 0
                conv, held = c, held + len(text)
                roles.append(role)
                texts.append(text)
        if roles:
            yield block()

    return run


def blocks_of(rows: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, one row a block, with the faults of each, written."""
    spark = rows.sparkSession
    bound_batches(spark)
    known = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by ranges of the order, equal rows by their number, so no conversation is one task's
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, TEXT_ORDER), F.xxhash64("text"), F.col("number")]
    ranged = known.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = cut(ranged.select("conv_id", "role", "text").mapInArrow(released(_into_blocks(block_turns, block_bytes)), _BLOCK))
    # a row is the first of its like where its (block, place) is the least of all
    each = made.select("conv_id", "block", F.posexplode("digests").alias("place", "digest"))
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "place")).alias("at"))
    firsts = first.groupBy(F.col("at.block").alias("block")).agg(F.collect_list("at.place").alias("firsts"))  # at most a block's rows
    joined = made.drop("digests").join(firsts, "block", "left")
    judged = F.expr(f"transform(faults, (f, p) -> CASE WHEN f = {BLANK} OR array_contains(firsts, p) THEN f ELSE {DUPLICATE} END)")
    return cut(joined.select("conv_id", "block", "roles", "texts", judged.alias("faults"), F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")))


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def _out(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


_INTS = pa.list_(pa.int64())


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["conv_id"], r["block"], block_costs(list(zip(r["initials"], r["faults"], strict=True)))) for r in _rows_of(batch)]
        if rows:
            yield _out(rows, ("conv_id", "block", "costs"), (pa.int64(), pa.int64(), _INTS))


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to the end behind every block; blocks come last one first."""
    conv, after, begun = None, list(ENDING), False
    for batch in batches:
        rows = []
        for r in _rows_of(batch):
            if not begun or r["conv_id"] != conv:
                conv, after, begun = r["conv_id"], list(ENDING), True
            rows.append((r["block"], after))
            after = carried(r["costs"], after)
        if rows:
            yield _out(rows, ("block", "after"), (pa.int64(), _INTS))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a block for every state before it."""
    for batch in batches:
        rows = []
        for r in _rows_of(batch):
            trace = Trace(list(zip(r["initials"], r["faults"], strict=True)), r["after"])
            reached = [trace.edits(s)[1] if trace.layers.least(trace.words[0], s) < NO_WAY else s for s in range(4)]
            rows.append((r["conv_id"], r["block"], r["after"], reached))
        if rows:
            yield _out(rows, ("conv_id", "block", "after", "exits"), (pa.int64(), pa.int64(), _INTS, _INTS))


def _from_the_beginning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before every block; blocks come in order."""
    conv, state, begun = None, START, False
    for batch in batches:
        rows = []
        for r in _rows_of(batch):
            if not begun or r["conv_id"] != conv:
                conv, state, begun = r["conv_id"], START, True
            rows.append((r["block"], r["after"], state))
            state = r["exits"][state]
        if rows:
            yield _out(rows, ("block", "after", "enter"), (pa.int64(), _INTS, pa.int32()))


REPAIRED = "conv_id long, block long, edits string, cost long, leave int, roles array<string>, texts array<string>, faults array<int>, initials array<string>"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "block", "edits", "cost", "leave", "roles", "texts", "faults", "initials")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
    for batch in batches:
        for r in _rows_of(batch):
            enter = r["enter"] or START
            edits, leave, cost = Trace(list(zip(r["initials"], r["faults"], strict=True)), r["after"] or list(ENDING)).edits(enter)
            made = applied(edits, enter, r["roles"], r["texts"])
            yield _out([(r["conv_id"], r["block"], edits, cost, leave, [a for a, _ in made], [b for _, b in made], r["faults"], r["initials"])], names, kinds)


def repair(rows: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of repaired conversations, from rows (conv_id, turn, role, text).

    A block has its ``edits`` (K kept, R given another role, D deleted, I inserted), their
    ``cost``, the state it leaves in, the ``roles`` and ``texts`` of the rows that are left,
    and ``faults`` and ``initials`` of the rows that came in; what ``ENDINGS`` adds behind
    the last block is not in it. Rows are in order of ``turn`` (null first), then role, the
    first ``TEXT_ORDER`` characters of the text and a hash of it. A null role or text is one
    space, an empty role (no initial) is no role that may be kept; rows without conv_id are one conversation; repeated rows are duplicates. Other
    columns are not read; an empty table gives no rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = blocks_of(rows, block_turns, block_bytes)
    several = made.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    light = made.select("conv_id", "block", "faults", "initials")
    long_ones = cut(light.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").repartition(parts, "block"))
    costs = long_ones.mapInArrow(released(_costs), "conv_id long, block long, costs array<long>")
    after = costs.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc()).mapInArrow(released(_from_the_end), "block long, after array<long>")
    exits = long_ones.join(after, "block").mapInArrow(released(_exits), "conv_id long, block long, after array<long>, exits array<long>")
    known = exits.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(released(_from_the_beginning), "block long, after array<long>, enter int")
    return made.join(cut(known), "block", "left").mapInArrow(released(_traced), REPAIRED)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, block, place, role, text) of the rows that ``repair`` leaves."""
    pairs = F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("place", "row")
    return repaired.select("conv_id", "block", pairs).select("conv_id", "block", "place", "row.role", "row.text")


SUMMARY = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its blocks in order; a hash of the whole text can only be taken in order."""
    names = tuple(c.split()[0] for c in SUMMARY.split(", "))
    kinds = (*[pa.int64()] * 6, pa.string(), pa.string())
    conv, begun = None, False
    counts, illegal, cost, audit, digest, written, before, leave = [0] * 4, 0, 0, [], hashlib.sha256(), 0, "", START

    def add(role: str, text: str) -> None:
        nonlocal written
        digest.update((("\n" if written else "") + f"{role}:{text}").encode())
        written += 1

    def finish() -> tuple:
        for name in ENDINGS[leave]:
            add(name, "")
        return conv, counts[BLANK], counts[DUPLICATE], counts[CUT_SHORT], illegal, cost + ENDING[leave], "".join(audit) + "I" * len(ENDINGS[leave]), digest.hexdigest()

    for batch in batches:
        out = []
        for r in _rows_of(batch):
            if not begun or r["conv_id"] != conv:
                if begun:
                    out.append(finish())
                conv, begun = r["conv_id"], True
                counts, illegal, cost, audit, digest, written, before = [0] * 4, 0, 0, [], hashlib.sha256(), 0, None
            for initial, fault in zip(r["initials"], r["faults"], strict=True):
                counts[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
            cost, leave = cost + r["cost"], r["leave"]
            audit.append(r["edits"])
            for role, text in zip(r["roles"], r["texts"], strict=True):
                add(role, text)
        if out:
            yield _out(out, names, kinds)
    if begun:
        yield _out([finish()], names, kinds)


def summaries(repaired: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``repair``.

    The blocks of a conversation are read in order by one task, which holds one of them and the audit.
    """
    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return repaired.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(released(_summed), SUMMARY)


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between a conversation's first and last turn; 0 where all are null."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    found = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return found.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 rows are dropped, emptied, stripped of ends, repeated or given to the user."""
    known = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = known.withColumn("kind", F.crc32(key) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``conversations``, after the contract's damage."""
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = damaged(given)
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found, gaps = summaries(repair(rows)).withColumnRenamed("conv_id", "_c"), turn_gaps(rows).withColumnRenamed("conv_id", "_g")
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(gaps, F.col("conv_id").eqNullSafe(F.col("_g")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
octets AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) AS r(i))),
dealt AS (
    SELECT given.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM given, octets),
rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS bare, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS earlier FROM placed),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
inserts(a, b, letters, lines) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
    (0, 2, 'I', E'user:\n'), (1, 2, 'I', E'user:\n'), (2, 3, 'I', E'assistant:\n'), (3, 2, 'I', E'user:\n'),
    (0, 3, 'II', E'user:\nassistant:\n'), (1, 3, 'II', E'user:\nassistant:\n'), (2, 2, 'II', E'assistant:\nuser:\n'), (3, 3, 'II', E'user:\nassistant:\n')),
edits(a, b, letter, initial, price, named) AS (VALUES (0, 0, 'D', '', 4, ''), (1, 1, 'D', '', 4, ''), (2, 2, 'D', '', 4, ''), (3, 3, 'D', '', 4, ''),
    (0, 1, 'K', 's', 0, ''), (0, 2, 'K', 'u', 0, ''), (1, 2, 'K', 'u', 0, ''), (3, 2, 'K', 'u', 0, ''), (2, 3, 'K', 'a', 0, ''),
    (0, 2, 'R', '', 3, 'user'), (1, 2, 'R', '', 3, 'user'), (3, 2, 'R', '', 3, 'user'), (2, 3, 'R', '', 3, 'assistant')),
moves AS (SELECT i.a, e.b, letters || letter AS letters, lines, letter, initial, price + 3 * length(letters) AS price, named FROM inserts i JOIN edits e ON i.b = e.a),
paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''} AS best FROM counts
    UNION ALL
    SELECT conv_id, place, state, min(best) AS best FROM (
        SELECT p.conv_id, j.place, m.b AS state, {'cost': p.best.cost + m.price + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': p.best.audit || m.letters,
            'body': p.best.body || m.lines || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || E'\n' ELSE m.named || ':' || j.text || E'\n' END} AS best
        FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.place = p.place + 1
        JOIN moves m ON m.a = p.state AND (m.letter <> 'K' OR m.initial = j.initial) AND (m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))) GROUP BY ALL),
ends AS (
    SELECT p.conv_id, min({'cost': p.best.cost + e.price, 'audit': p.best.audit || e.letters, 'body': p.best.body || e.lines}) AS best
    FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.place = c.n
    JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', E'user:\nassistant:\n'), (2, 3, 'I', E'assistant:\n'), (3, 0, '', '')) AS e(state, price, letters, lines) USING (state)
    GROUP BY p.conv_id)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
    sha256(CASE WHEN best.body IS NULL OR best.body = '' THEN '' ELSE left(best.body, length(best.body) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
"""

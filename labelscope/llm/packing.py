"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into whole sequences, its first piece being the
shorter one; only these first pieces and the short documents are to be packed. In order of
length they are dealt in turn to shards of ``SHARD`` pieces, which so have like lengths. On
every shard ``ISLANDS`` populations evolve apart: crossover takes whole well-filled sequences
of one packing into another, drops the sequences that then hold a piece twice, and puts the
displaced pieces back by best fit, longest first. Between epochs each island's best packing
moves on to the next island. The full sequences of a shard stay; the others, and as many full
ones of the most (so the shortest) pieces, are dealt anew with those of all shards, until one
shard holds them. Where that would settle less than three tenths of the pieces, only the
emptiest sixteenth of the sequences is dealt anew, or none. So no packing is ever held for
more than a shard, and little of what a shard leaves over is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm.bpe_ids import Ids, unsure_characters, vocabulary_path
from labelscope.llm.common import bound_batches, cut, released, table

CAPACITY = 1024
#: The id that ends every document.
END = 2
#: Pieces of a shard, on average.
SHARD = 4096
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 3, 8
#: Epochs of the last shard, which closes all its sequences.
LAST_EPOCHS = 6


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences: by the sum, and by the pieces too long to share one (Martello and Toth)."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    best = -(-int(sums[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = int(below[-1] - below[capacity - k])  # longer than capacity - k: alone beside pieces of k and more
        half = int(below[capacity - k] - below[capacity // 2])
        room = half * capacity - int(sums[capacity - k] - sums[capacity // 2])
        rest = int(sums[capacity // 2] - sums[k - 1])
        best = max(best, alone + half + max(0, -(-(rest - room) // capacity)))
    return best


class Packing:
    """Sequences under construction, found by the room they have left."""

    def __init__(self, capacity: int, bins: np.ndarray, fill: list[int]):
        self.capacity, self.bins, self.fill = capacity, bins, fill
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0
        for b, f in enumerate(fill):
            if f < capacity:
                self._open(b)

    def _open(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room.setdefault(room, []).append(b)
        self.rooms |= 1 << room

    def best_fit(self, pieces: list[int], lengths: list[int]) -> None:
        """Put ``pieces`` (of ``lengths``), in their order, where least room stays."""
        for piece, length in zip(pieces, lengths, strict=True):
            fitting = self.rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                held = self.by_room[room]
                b = held.pop()
                if not held:
                    self.rooms ^= 1 << room
            else:
                b = len(self.fill)
                self.fill.append(0)
            self.bins[piece] = b
            self.fill[b] += length
            if self.fill[b] < self.capacity:
                self._open(b)


def packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of every piece by best fit in ``order``."""
    packing = Packing(capacity, np.empty(len(lengths), np.int32), [])
    packing.best_fit(order.tolist(), lengths[order].tolist())
    return packing.bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the fuller ones (mean square of fills): less is better."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float(((fill / capacity) ** 2).sum())


def repacked(lengths: np.ndarray, bins: np.ndarray, gone: np.ndarray, injected: np.ndarray, capacity: int) -> np.ndarray:
    """``bins`` without the sequences ``gone`` (a flag each); ``injected`` pieces (sequence number or -1) come in whole, displaced ones by best fit.

    Sequences of ``bins`` that hold an injected piece must be among those gone.
    """
    stays = ~gone[bins]
    number = np.cumsum(~gone) - 1
    child = np.where(stays, number[bins], -1).astype(np.int32)
    kept = int((~gone).sum())
    inside = injected >= 0
    if inside.any():
        child[inside] = kept + np.unique(injected[inside], return_inverse=True)[1]
        kept = int(child.max()) + 1
    placed = child >= 0
    fill = np.bincount(child[placed], lengths[placed], minlength=kept).astype(int).tolist()
    displaced = np.flatnonzero(~placed)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    packing = Packing(capacity, child, fill)
    packing.best_fit(displaced.tolist(), lengths[displaced].tolist())
    return packing.bins


def crossover(lengths: np.ndarray, first: np.ndarray, second: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``first`` with a part of ``second``'s fullest sequences, and without the emptiest of its own (and some full ones, for their short pieces)."""
    fill = np.bincount(second, lengths)
    ranked = np.lexsort((rng.random(len(fill)), -fill))
    count = max(1, int(len(fill) * rng.uniform(0.05, 0.3)))
    fullest = ranked[: max(1, int((fill >= capacity).sum()), len(fill) // 2)]
    taken = np.zeros(len(fill), bool)
    taken[rng.permutation(fullest)[:count]] = True
    injected = np.where(taken[second], second, -1)
    gone = np.zeros(int(first.max()) + 1, bool)
    gone[first[injected >= 0]] = True  # they would hold a piece twice
    own = np.bincount(first, lengths)
    unfilled = np.flatnonzero(own < capacity)
    several = max(2, int(len(unfilled) * rng.uniform(0.3, 1)))
    gone[unfilled[np.argsort(own[unfilled], kind="stable")][:several]] = True
    gone[rng.permutation(np.flatnonzero(own >= capacity))[: several // 2]] = True
    return repacked(lengths, first, gone, injected, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, offspring: int = OFFSPRING, size: int = POPULATION) -> list[np.ndarray]:
    """The packings of an island after an epoch, best first. ``population`` may be empty; pieces have 1 to ``capacity`` tokens."""
    rng = np.random.default_rng(seed)
    people = [np.asarray(p, np.int32) for p in population]
    while len(people) < size:
        noise = 1.0 if not people and seed % ISLANDS == 0 else rng.uniform(0.9, 1.1, len(lengths))
        people.append(packed(lengths, np.argsort(-(lengths * noise), kind="stable"), capacity))
    scored = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    least, open_ones = least_bins(lengths, capacity), min(1, int(lengths.sum()) % capacity)
    for born in range(offspring):
        best = scored[0][2]
        if scored[0][0][0] <= least and int((np.bincount(best, lengths) < capacity).sum()) <= open_ones:
            break
        a, b = (int(x) for x in rng.choice(len(scored), 2, replace=False))
        a, b = min(a, b), max(a, b)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        scored.append((fitness(lengths, child, capacity), len(people) + born, child))
        scored = sorted(scored, key=lambda x: x[:2])[: max(size, 2)]
    return [p for _, _, p in scored[:size]]


# ---- the same on Spark


def pieces_of(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n_ids`` ids (1 at least): whole ones, the first one shorter where needed."""
    first = (n_ids - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n_ids, capacity))]


def _encode(shared, capacity: int):
    """Rows of documents with the lengths and checksums of their pieces; texts and ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _worker_ids(shared)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            items, counts, sums = [], [], []
            for text in batch.column("text"):
                found = np.append(ids.encode(text.as_py() or ""), END).astype("<u4")
                items.append(item)
                counts.append(len(found))
                sums.append([zlib.crc32(found[a : a + n].tobytes()) for a, n in pieces_of(len(found), capacity)])
                item += 1
            columns = [pa.array(items, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "n_ids", "sums"])

    return run


_encoders: dict[int, Ids] = {}


def _worker_ids(shared) -> Ids:
    key = hash(shared.value[0])
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Ids(*shared.value)
    return _encoders[key]


def encoded(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(item, doc_id, n_ids, sums) of every row of ``docs``, written: its ids with the end and the crc32 of each piece."""
    spark = docs.sparkSession
    bound_batches(spark, 500)
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    shared = spark.sparkContext.broadcast((text, unsure_characters()))  # a few MB, the tokenizer's file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(released(_encode(shared, capacity)), "item long, doc_id long, n_ids long, sums array<long>"))


_ISLAND = "shard long, island int, items array<long>, lengths array<int>, population array<array<int>>"


def _epoch(capacity: int, epoch: int):
    """One epoch on every row, an island each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths = row.column("lengths")[0].values.to_numpy()
                shard, island = row.column("shard")[0].as_py(), row.column("island")[0].as_py()
                population = [np.asarray(p, np.int32) for p in row.column("population")[0].as_py()]
                seed = zlib.crc32(f"{shard}:{epoch}".encode()) * ISLANDS + island
                people = evolve(lengths.astype(np.int64), population, capacity, seed)
                columns = [row.column(n) for n in ("shard", "island", "items", "lengths")]
                columns.append(pa.array([[p.tolist() for p in people]], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "island", "items", "lengths", "population"])

    return run


def _migrated(islands: DataFrame) -> DataFrame:
    """Every island's best packing takes the place of the next island's last one."""
    guests = islands.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("population")[0].alias("guest"))
    met = islands.join(guests, ["shard", "island"])
    return met.withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("guest"))).select("shard", "island", "items", "lengths", "population")


def _round(short: DataFrame, shards: int, capacity: int, epochs: int) -> DataFrame:
    """(shard, bin, level, items, lengths, offsets) of the sequences of ``short`` (item, length), written; best island of each shard."""
    spark = short.sparkSession
    order = ["length", F.xxhash64("item", F.lit(shards)), "item"]
    ranged = short.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id() * 7919  # dealt in turn, so all shards have like lengths
    dealt = ranged.withColumn("shard", F.pmod(place, F.lit(shards)).cast("long"))
    grouped = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("n"), "item"))).alias("rows"))  # about SHARD pieces
    islands = grouped.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("rows.item").alias("items"),
        F.transform("rows", lambda r: (-r["n"]).cast("int")).alias("lengths"), F.array().cast("array<array<int>>").alias("population"),
    ).repartition("shard", "island")
    for epoch in range(epochs):
        islands = cut((_migrated(islands) if epoch else islands).mapInArrow(released(_epoch(capacity, epoch)), _ISLAND))
    scored = islands.withColumn("best", F.col("population")[0]).mapInArrow(released(_sequences(capacity)), _SEQUENCES)
    chosen = scored.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "squares", "island")).alias("bins"))
    return cut(chosen.select("shard", F.explode("bins").alias("b")).select("shard", "b.*"))


_SEQUENCES = "shard long, island int, n_bins int, squares double, bins array<struct<bin: int, level: int, items: array<long>, lengths: array<int>, offsets: array<long>>>"


def _levels(fill: np.ndarray, pieces: np.ndarray, capacity: int) -> np.ndarray:
    """0 for settled sequences: the full ones, but for as many of the most pieces as there are unfilled ones; 2 for the emptiest sixteenth of the others, else 1."""
    level = (fill < capacity).astype(np.int32)
    full, unfilled = np.flatnonzero(level == 0), np.flatnonzero(level)
    level[full[np.argsort(-pieces[full], kind="stable")][: len(unfilled)]] = 1
    level[unfilled[np.argsort(fill[unfilled], kind="stable")][: -(-len(unfilled) // 16)]] = 2
    return level


def _sequences(capacity: int):
    """The best packing of every island as sequences with their pieces."""
    lists = [("items", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("bin", pa.int32()), ("level", pa.int32()), *lists]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, island, items, lengths, bins = (batch.column(n)[k].as_py() for n in ("shard", "island", "items", "lengths", "best"))
                count, squares = fitness(np.array(lengths, np.int64), np.array(bins, np.int64), capacity)
                levels = _levels(np.bincount(bins, lengths), np.bincount(bins), capacity).tolist()
                made: list[dict] = [{"bin": b, "level": v, "items": [], "lengths": [], "offsets": []} for b, v in enumerate(levels)]
                filled = [0] * count
                for item, length, b in zip(items, lengths, bins, strict=True):
                    made[b]["items"].append(item)
                    made[b]["lengths"].append(length)
                    made[b]["offsets"].append(filled[b])
                    filled[b] += length
                values = (shard, island, count, squares, made)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["shard", "island", "n_bins", "squares", "bins"])

    return run


def pack_short(short: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(item, sequence_id, offset) of every row of ``short`` (item, length from 1 to ``capacity``; items are distinct).

    Sequence ids are not negative. An empty table gives no rows; equal lengths are told
    apart by item, so reruns agree.
    """
    number, closed = 0, None
    left, count = short, short.count()
    while count:
        last = count <= shard
        made = _round(left, max(1, -(-count // shard)), capacity, LAST_EPOCHS if last else EPOCHS)
        sizes = {r["level"]: r["n"] for r in made.groupBy("level").agg(F.sum(F.size("items")).alias("n")).collect()}  # three rows
        # the first choice that leaves at most seven tenths for the next round, or none, so that rounds end
        again = next((v for v in (1, 2) if not last and 10 * sum(n for level, n in sizes.items() if level >= v) <= 7 * count), 3)
        opened = made.filter(F.col("level") >= again).select(F.explode(F.arrays_zip("items", "lengths")).alias("p")).select(F.col("p.items").alias("item"), F.col("p.lengths").alias("length"))
        kept = made.filter(F.col("level") < again)
        ids = (F.lit(number) * F.lit(1 << 57) + F.col("shard") * F.lit(1 << 16) + F.col("bin")).alias("sequence_id")
        placed = kept.select(ids, F.explode(F.arrays_zip("items", "offsets")).alias("p")).select(F.col("p.items").alias("item"), "sequence_id", F.col("p.offsets").alias("offset"))
        closed = placed if closed is None else closed.unionByName(placed)
        left, count, number = opened, sum(n for level, n in sizes.items() if level >= again), number + 1
    return closed if closed is not None else short.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs`` (doc_id, text).

    A document is its ids and the id ``END``; a null or empty text is ``END`` alone. Repeated
    rows are documents of their own, ids may be null; other columns are not read; an empty
    table gives no rows. Only documents of more than ``capacity`` ids are cut. Whole pieces
    are sequences of their own, with negative numbers; the others go through ``pack_short``.
    """
    found = encoded(docs, capacity, vocabulary)
    first = ((F.col("n_ids") - 1) % capacity + 1).cast("int")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    whole = found.withColumn("first", first).filter(f"n_ids >= {capacity}").select("doc_id", "first", F.posexplode("sums").alias("piece", "ids_crc32")).filter(f"piece > 0 OR first = {capacity}")
    whole = whole.select(
        "doc_id", "piece", F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"),
        "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    short = found.withColumn("length", first).filter(f"length < {capacity}")
    placed = pack_short(short.select("item", "length"), capacity, shard)
    packed_ones = short.join(placed, "item").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("sums")[0].alias("ids_crc32"), "sequence_id", "offset"
    )
    return whole.select(*columns).unionByName(packed_ones.select(*columns))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))

"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a run of documents of one task. Its index holds the words that occur in
the benchmark as symbols; any other word ends a run, as does the end of a text,
and runs shorter than the shortest window are left out, since no window can occur
in them. Every distinct window is searched backwards through wavelet-tree ranks,
its occurrences are located by sampled suffix positions, and the covered words are
merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, cut, released, table
from labelscope.llm.fm_index import FMIndex

WINDOW = 13
#: Contaminated: n_hit > 0 and SHARE * n_hit >= n_words.
SHARE = 20
#: Symbols or documents after which a task closes a shard.
SHARD_SYMBOLS, SHARD_DOCS = 1 << 20, 50_000
#: UTF-8 bytes of benchmark text that one broadcast may hold; more is searched in parts.
BROADCAST_BYTES = 16 << 20

REPORT = "row long, doc_id long, n_words long, n_hit long, spans array<struct<first:int,last:int>>, items array<string>"


#: Windows that are searched at once in an index.
SEARCHED = 1 << 16


@dataclass
class Patterns:
    """Distinct windows of one length: where each starts in the symbols, and its items as a range of ``owners``."""

    starts: np.ndarray
    offsets: np.ndarray
    owners: np.ndarray


class Phrases:
    """The windows of a benchmark in flat arrays: word hashes, symbols of all items, patterns by length.

    Items are numbered by their ids in string order; equal ids are one item.
    """

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW):
        self.items, item = np.unique(np.array(ids, dtype=object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, part, at in tk.slices(*tk.buffers(texts)) if ids else ():
            part = tk.LOWER[part]
            starts, ends, woffs = tk.word_spans(part, at, tk.ALNUM)
            hashes.append(tk.word_hashes(part, starts, ends))
            counts.append(np.diff(woffs))
        words, count = np.concatenate(hashes), np.concatenate(counts)
        vocabulary, symbols = np.unique(words, return_inverse=True)
        self.vocabulary = tk.HashIndex(vocabulary)
        self.n_words = len(vocabulary)
        self.symbols = (symbols + 1).astype(np.int32)
        size = np.minimum(window, count)
        n = np.where(count > 0, count - size + 1, 0)
        self.by_length: dict[int, Patterns] = {}
        for length in np.unique(size[n > 0]).tolist():
            mine = np.flatnonzero((size == length) & (n > 0))
            first = tk.ranges((np.cumsum(count) - count)[mine], n[mine])
            self.by_length[length] = self._distinct(first, np.repeat(item[mine], n[mine]), length)
        self.shortest = min(self.by_length, default=0)

    def _distinct(self, first: np.ndarray, item: np.ndarray, length: int) -> Patterns:
        key = np.zeros(len(first), np.uint64)
        for j in range(length):
            key = tk.mix(key + self.symbols[first + j].astype(np.uint64))
        order = np.lexsort((item, key))
        first, item, key = first[order], item[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        for j in range(length):  # windows that only share the key are patterns of their own
            symbol = self.symbols[first + j]
            new[1:] |= symbol[1:] != symbol[:-1]
        group = np.cumsum(new) - 1
        kept = new.copy()
        kept[1:] |= item[1:] != item[:-1]
        offsets = np.searchsorted(group[kept], np.arange(int(new.sum()) + 1))
        return Patterns(first[new].astype(np.int32), offsets, item[kept].astype(np.int32))

    def windows(self, length: int, lo: int, hi: int) -> np.ndarray:
        """Patterns ``lo`` to ``hi`` of a length, a row of symbols each."""
        return self.symbols[self.by_length[length].starts[lo:hi, None] + np.arange(length)].astype(np.int64)


class Shard:
    """Documents of one task on their way to a common index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.ids: list[pa.Array] = []
        self.rows: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n_docs = self.n_symbols = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows.append(batch.column("row"))
        self.ids.append(batch.column("doc_id"))
        raw, offs = tk.buffers(batch.column("text"))
        for lo, hi, part, at in tk.slices(raw, offs):
            part = tk.LOWER[part]
            starts, ends, woffs = tk.word_spans(part, at, tk.ALNUM)
            self.counts.append(np.diff(woffs))
            if self.phrases.shortest:
                ids = self.phrases.vocabulary.ids(tk.word_hashes(part, starts, ends))
                first, last = tk.runs(ids >= 0, woffs)
                long = last - first >= self.phrases.shortest
                first, last = first[long], last[long]
                at_word = tk.ranges(first, last - first + 1)  # one more for the break
                symbols = np.append(ids, -1)[at_word] + 1
                if len(first):
                    symbols[np.cumsum(last - first + 1) - 1] = 0
                owner = np.repeat(np.searchsorted(woffs, first, side="right") - 1, last - first + 1)
                self.symbols.append(symbols.astype(np.int64))
                self.places.append(at_word - woffs[owner])
                self.owners.append(owner + self.n_docs)
                self.n_symbols += len(symbols)
            self.n_docs += hi - lo

    def full(self) -> bool:
        return self.n_symbols >= SHARD_SYMBOLS or self.n_docs >= SHARD_DOCS

    def report(self) -> pa.RecordBatch:
        n_words = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        n_hit = np.zeros(self.n_docs, np.int64)
        spans: list[list[dict[str, int]]] = [[] for _ in range(self.n_docs)]
        items = np.zeros(0, np.int64)  # document and item in one number
        n_items = len(self.phrases.items)
        if self.n_symbols:
            text, place, owner = (np.concatenate(x) for x in (self.symbols, self.places, self.owners))
            index = FMIndex(text, self.phrases.n_words)
            cover = np.zeros(len(text) + 1, np.int64)
            for size, patterns in self.phrases.by_length.items():
                for lo in range(0, len(patterns.starts), SEARCHED):
                    low, high = index.search(self.phrases.windows(size, lo, lo + SEARCHED))
                    found = np.flatnonzero(high > low)
                    if not len(found):
                        continue
                    often = (high - low)[found]
                    at = index.locate(tk.ranges(low[found], often))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    met = np.unique(owner[at] * len(patterns.starts) + np.repeat(lo + found, often))
                    document, pattern = met // len(patterns.starts), met % len(patterns.starts)
                    each = patterns.offsets[pattern + 1] - patterns.offsets[pattern]
                    owned = patterns.owners[tk.ranges(patterns.offsets[pattern], each)]
                    items = np.union1d(items, np.repeat(document, each) * n_items + owned)
            hit = np.cumsum(cover[:-1]) > 0
            n_hit = np.bincount(owner[hit], minlength=self.n_docs)
            for a, b in zip(*tk.runs(hit, np.array([0, len(hit)])), strict=True):
                spans[owner[a]].append({"first": int(place[a]), "last": int(place[b - 1])})
        per_document = np.searchsorted(items, np.arange(self.n_docs + 1) * max(n_items, 1))
        names = pa.array(self.phrases.items[items % max(n_items, 1)].tolist(), pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(self.rows), pa.concat_arrays(self.ids), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.ListArray.from_arrays(per_document.astype(np.int32), names),
            ],
            names=["row", "doc_id", "n_words", "n_hit", "spans", "items"],
        )


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shared.value)
        for batch in batches:
            shard.add(batch)
            if shard.full():
                yield shard.report()
                shard = Shard(shared.value)
        if shard.n_docs:
            yield shard.report()

    return scan


def _merge(spans: pd.Series) -> pd.Series:
    def one(parts):
        merged: list[dict[str, int]] = []
        for first, last in sorted((p["first"], p["last"]) for p in parts):
            if merged and first <= merged[-1]["last"]:
                merged[-1]["last"] = max(last, merged[-1]["last"])
            else:
                merged.append({"first": first, "last": last})
        return merged

    return spans.map(one)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every row of ``docs`` (doc_id, text).

    ``spans`` are merged runs of hit words (positions from 0, ends included), ``items``
    the sorted ids, as strings, of benchmark items with an occurring window. A null or
    empty text has no words; benchmark rows without id or words have no windows; repeated
    rows come out as often as they came in; other columns are not read. The benchmark
    is broadcast while its texts fit ``broadcast_bytes``; a larger one is searched part
    by part, each part in a pass over the texts, and the spans of the parts are merged.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    bench = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    parts = max(1, -(-size // broadcast_bytes))
    texts = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts > 1:
        texts = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    reports = None
    for part in range(parts):
        rows = (bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else bench).toArrow()
        shared = spark.sparkContext.broadcast(Phrases(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks(), window))
        report = texts.mapInArrow(released(_scan(shared)), REPORT)
        if parts > 1:  # one part after the other, so that the driver and the workers hold one
            report = cut(report)
            shared.destroy()
        reports = report if reports is None else reports.unionByName(report)
    if parts > 1:
        merge = F.pandas_udf(_merge, "array<struct<first:int,last:int>>")
        reports = reports.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).withColumn("spans", merge("spans"))
        covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"] + 1).cast("long"))
        reports = reports.withColumn("n_hit", covered)
    return reports.select("doc_id", "n_words", "n_hit", "spans", "items")


def is_contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (and what stands between them)."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = tk.word_spans(tk.LOWER[raw], np.array([0, len(raw)]), tk.ALNUM)
    out, at = [], 0
    for first, last in sorted(spans):
        out.append(data[at : starts[first]])
        at = int(ends[last])
    return b"".join([*out, data[at:]]).decode()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all of ``documents`` against all of ``benchmark``."""
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT item_id, n, w[i : i + n - 1] AS p FROM bi),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
occ AS (SELECT DISTINCT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS p FROM di) d JOIN win ON d.n = win.n AND d.p = win.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

"""Toxicity: score texts after noisy-channel deobfuscation.

The character language model counts triples over all documents. A lexicon of words and
word beginnings that mark toxic documents, and its weights, are learned from a bounded
sample of labelled rows (``TRAIN_DOCS``, ``TRAIN_BYTES``), on restored texts; every document is then
restored and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, cut, document_remainder, keep_scored, released, table, training_rows, within_bytes
from labelscope.llm.deobfuscate import N_SYMBOLS, Restorer, count_trigrams, language_model

#: Labelled rows and bytes of text that the lexicon is learned from; a text of more than an eighth of the bytes is not among them.
TRAIN_DOCS, TRAIN_BYTES = 16_000, 400_000_000
#: Lengths in bytes of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: A lexicon feature is in at least MIN_POSITIVE toxic documents of the sample, which bounds their number.
MIN_POSITIVE = 4
#: A lexicon feature's rate in toxic documents is at least LIFT times that in others.
LIFT = 4.0
#: Odds of 1 to ODDS against a feature's precision being a coincidence; ridge penalty of the weights.
ODDS, RIDGE = 1e3, 2e-5
#: A feature of at least this precision, at odds of 1 to CHANCE against coincidence, tells by itself.
PRECISION, CHANCE = 0.995, 1e8
HELD_OUT = (5, 0)


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character triples over the whole texts of all documents.

    A null text is empty and counts nothing, a repeated row counts again, no triple spans two
    texts; other columns are not read; an empty table gives zeros.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            raw, offs = tk.buffers(batch.column("text"))
            for _, _, part, at in tk.slices(raw, offs):
                total += count_trigrams(tk.LOWER[part], at)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(released(count), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_SYMBOLS**3, np.int64)
    for triple, n in rows:  # at most N_SYMBOLS ** 3 rows
        counts[triple] = n
    return counts


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and word beginning of lower-cased texts; repeats stay."""
    starts, ends, woffs = tk.word_spans(raw, offs, tk.ALNUM)
    doc = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
    docs, hashes = [doc], [tk.word_hashes(raw, starts, ends)]
    for length in BEGINNINGS:
        long = np.flatnonzero(ends - starts > length)
        docs.append(doc[long])
        hashes.append(tk.mix(tk.word_hashes(raw, starts[long], starts[long] + length) + np.uint64(length)))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Lexicon:
    """Learned features with their weights; ``bias`` is the score of a text with none."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def index(self) -> tk.HashIndex:
        return tk.HashIndex(self.hashes)


def _restored(batches: Iterator[pa.RecordBatch], costs: np.ndarray):
    restorer = Restorer(costs)
    for batch in batches:
        raw, offs = tk.buffers(batch.column("text"))
        yield batch, [(lo, *restorer.texts(tk.LOWER[part], at, rivals=True)) for lo, _, part, at in tk.slices(raw, offs)]


def _present(parts, index: tk.HashIndex) -> np.ndarray:
    """Distinct (row, feature place) pairs of a batch."""
    found = [np.zeros((0, 2), np.int64)]
    for lo, raw, offs in parts:
        doc, hashes = features(raw, offs)
        place = index.ids(hashes)
        hit = place >= 0
        found.append(np.unique(np.stack([doc[hit] + lo, place[hit]], 1), axis=0))
    return np.concatenate(found)


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, label 0 or 1) and restored texts of ``docs``.

    At most ``train_docs`` labelled rows with at most ``train_bytes`` bytes of text
    together, see ``training_rows`` and ``within_bytes``. With only one class,
    or none, the lexicon is empty and the bias says the class (not toxic where there
    are no labels).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = cut(within_bytes(training_rows(docs, labels, train_docs), train_bytes))
    shared = spark.sparkContext.broadcast(costs)

    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}  # a row a class
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), 4.0 if n1 else -4.0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a feature and its clean texts; 1 and 2: a feature and a mark of a toxic text."""
        for batch, parts in _restored(batches, shared.value):
            label = batch.column("label").to_numpy()
            for lo, raw, offs in parts:
                doc, hashes = features(raw, offs)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                doc, hashes = doc[new], hashes[new]
                toxic = label[lo + doc] == 1
                values, counts = np.unique(hashes[~toxic], return_counts=True)
                rows = [(values, np.zeros(len(values), np.int64), counts)]
                rows += [(hashes[toxic], m.view(np.int64)[doc[toxic]], np.ones(toxic.sum(), np.int64)) for m in _marks(raw, offs)]
                for kind, (feature, mark, n) in enumerate(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(np.full(len(n), kind, np.int32)), pa.array(mark), pa.array(n)], names=["feature", "kind", "mark", "n"])

    counted = texts.mapInArrow(released(emit), "feature long, kind int, mark long, n long").groupBy("feature", "kind", "mark").agg(F.sum("n").alias("n"))
    neg = F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0))
    counted = counted.groupBy("feature").agg(neg.alias("neg"), F.least(F.count_if(F.col("kind") == 1), F.count_if(F.col("kind") == 2)).alias("pos"))
    pos, neg, share = F.col("pos"), F.col("neg"), n1 / (n0 + n1)
    counted = counted.filter(pos >= MIN_POSITIVE).withColumn("p", F.least(F.greatest(pos / (pos + neg), F.lit(1e-9)), F.lit(1 - 1e-9)))
    p = F.col("p")
    counted = counted.withColumn("surprise", (pos + neg) * (p * F.log(p / share) + (1 - p) * F.log((1 - p) / (1 - share))))
    told = ((pos + 0.1) / (n1 + 0.2) >= LIFT * (neg + 0.1) / (n0 + 0.2)) & (F.col("surprise") >= float(np.log(ODDS)))
    rows = counted.filter(told).orderBy(F.desc("surprise"), "feature").select("feature").toArrow()
    candidates = rows.column("feature").to_numpy().view(np.uint64)
    chosen = spark.sparkContext.broadcast(candidates)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = tk.HashIndex(chosen.value)
        for batch, parts in _restored(batches, shared.value):
            pairs = _present(parts, index)
            lists = np.split(pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(1, batch.num_rows)))
            places = pa.array([x.tobytes() for x in lists], pa.binary())
            marks = np.zeros((2, batch.num_rows), np.uint64)
            for lo, raw, offs in parts:
                marks[:, lo : lo + len(offs) - 1] = _marks(raw, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), places, *(pa.array(m.view(np.int64)) for m in marks)], names=["doc_id", "label", "places", "m1", "m2"]
            )

    got = texts.mapInArrow(released(look), "doc_id long, label int, places binary, m1 long, m2 long").collect()
    got.sort(key=lambda r: (r["doc_id"], r["places"]))
    y = np.array([r["label"] for r in got], np.float64)
    marks = np.array([(r["m1"], r["m2"]) for r in got])
    places = [np.frombuffer(r["places"], np.int32) for r in got]
    del got
    return _weigh(places, y, candidates, marks)


def _marks(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Two minima over each text's feature hashes: near copies mostly have the same."""
    doc, hashes = features(raw, offs)
    out = np.full((2, len(offs) - 1), np.iinfo(np.int64).max, np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.minimum.at(out[k], doc, tk.mix(hashes ^ np.uint64(salt)) >> np.uint64(1))
    return out


def _weigh(rows: list[np.ndarray], y: np.ndarray, candidates: np.ndarray, marks: np.ndarray) -> Lexicon:
    n1, n0 = y.sum(), len(y) - y.sum()
    share = n1 / len(y)
    neg = np.zeros(len(candidates), np.int64)
    for at in np.flatnonzero(y == 0):
        neg[rows[at]] += 1  # a row's places are distinct
    # a group of near copies counts once: positives are counted by the texts' marks
    pos = np.full(len(candidates), len(y))
    ones = np.flatnonzero(y == 1)
    toxic = np.repeat(ones, [len(rows[at]) for at in ones])
    found = np.concatenate([rows[at] for at in ones])
    for k in range(marks.shape[1]):
        number = np.unique(marks[:, k], return_inverse=True)[1]
        pairs = np.unique(found.astype(np.int64) * len(y) + number[toxic])
        pos = np.minimum(pos, np.bincount(pairs // len(y), minlength=len(candidates)))
    seen = pos + neg
    precision = np.clip(pos / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    surprise = seen * (precision * np.log(precision / share) + (1 - precision) * np.log((1 - precision) / (1 - share)))
    lifted = (pos + 0.1) / (n1 + 0.2) >= LIFT * (neg + 0.1) / (n0 + 0.2)
    good = np.flatnonzero(lifted & (surprise >= np.log(ODDS)) & (pos >= MIN_POSITIVE))
    good = good[np.argsort(-surprise[good], kind="stable")]
    new = np.full(len(candidates), -1)
    new[good] = np.arange(len(good))
    kept = [new[r][new[r] >= 0] for r in rows]
    doc, place = np.repeat(np.arange(len(rows)), [len(r) for r in kept]), np.concatenate(kept)
    # logistic regression on presence, weights held positive
    w, b = np.zeros(len(good)), -1.0
    mw, vw, mb, vb = np.zeros(len(good)), np.zeros(len(good)), 0.0, 0.0
    for step in range(1, 401):
        logit = b + np.bincount(doc, weights=w[place], minlength=len(y))
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        gw, gb = np.bincount(place, weights=d[doc], minlength=len(good)) + RIDGE * w, d.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = np.maximum(w - 0.1 * (mw / fix) / (np.sqrt(vw / fix2) + 1e-9), 0)
        b -= 0.1 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    # what tells by itself is worth its own precision, however often it came with others in training
    alone = ((pos + 0.5) / (seen + 1))[good]
    telling = (precision[good] >= PRECISION) & (surprise[good] >= np.log(CHANCE))
    w[telling] = np.maximum(w[telling], (np.log(alone / (1 - alone)) - b)[telling])
    return Lexicon(candidates[good], w, float(b))


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        costs, words = shared.value
        index = words.index()
        for batch, parts in _restored(batches, costs):
            pairs = _present(parts, index)
            logit = words.bias + np.bincount(pairs[:, 0], weights=words.weights[pairs[:, 1]], minlength=batch.num_rows)
            yield batch, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    return score


def score_toxicity(docs: DataFrame, costs: np.ndarray, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text).

    A null or empty text scores as one without any feature; a text of any length is
    scored whole. Repeated rows and null ids come out as they came in, each scored by its
    own text; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scored = _scored(spark.sparkContext.broadcast((costs, lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(run), "doc_id long, score double"
    )


def keep_civil(docs: DataFrame, costs: np.ndarray, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns (see ``keep_scored``)."""
    return keep_scored(docs, _scored(docs.sparkSession.sparkContext.broadcast((costs, lexicon))), lambda s: s < threshold)


def restored_texts(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """(doc_id, restored): lower-cased texts with disguised words restored; null stays null, empty stays empty.

    Repeated rows and null ids come out as they came in; among equally cheap readings the
    first of the lattice's order counts, where a character standing for itself comes first; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            out = [None if t is None else restorer.restore(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(restore), "doc_id long, restored string"
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``labels`` that toxicity may be learned from."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return labels.filter(document_remainder(HELD_OUT[0]) != HELD_OUT[1]).select("doc_id", F.col("toxic").alias("label"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's score from its whole text; a null id is not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    costs = language_model(corpus_trigrams(docs))
    scored = score_toxicity(docs, costs, fit(docs, training_labels(spark, sf_dir), costs))
    held = F.coalesce(document_remainder(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages that together cover it whole. Every passage is encoded by
vectorised counts over its bytes and words, then by a learned layer; gated attention
(Ilse et al., "Attention-based Deep Multiple Instance Learning") weighs the passages,
and the weighted representation is scored. Everything is learned from document labels.

Training reads a bounded sample of labelled rows (``TRAIN_DOCS``, the ones with the
smallest md5 of their id); every document is then scored over all its passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, cut, document_remainder, keep_scored, released, table, training_rows

PASSAGE_BYTES = 512
#: Labelled rows and bytes of text that a model is learned from; a text of more than an eighth of the bytes is not
#: among them. The driver holds 16-bit features of the bytes' passages: 0.15 GB.
TRAIN_DOCS, TRAIN_BYTES = 8000, 200_000_000
HIDDEN, ATTENTION = 24, 12
STEPS, BATCH, RATE, DECAY = 2000, 64, 3e-3, 1e-5
#: Standardised features are held within this.
CLIP = 6.0

# Byte classes: lower, upper, digit, space, newline, control, high byte, each mark of its own.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_FINE = np.full(256, 5, np.int64)
_FINE[97:123], _FINE[65:91], _FINE[48:58], _FINE[32], _FINE[10], _FINE[128:] = 0, 1, 2, 3, 4, 6
for _i, _b in enumerate(_MARKS):
    _FINE[_b] = 7 + _i
N_FINE = 7 + len(_MARKS)
# Coarser classes for pairs of neighbours: marks in five groups.
_COARSE = np.minimum(_FINE, 7)
for _b in _MARKS:
    _COARSE[_b] = {".": 7, ",": 7, ";": 7, ":": 7, "!": 8, "?": 8, "|": 9}.get(chr(_b), 10 if _b in b"#$%&*+=<>@^_~\\/" else 11)
N_COARSE = 12
N_WORD = 6
N_FEATURES = N_FINE + N_COARSE * N_COARSE + N_WORD


def passages(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, features of passages, passages per text as offsets) for slices of a column.

    An empty text is one passage without counts.
    """
    raw, offs = tk.buffers(column)
    for lo, hi, part, at in tk.slices(raw, offs):
        length = np.diff(at)
        count = np.maximum(1, -(-length // PASSAGE_BYTES))
        poffs = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(hi - lo), length)
        home = poffs[doc] + (np.arange(len(part)) - at[doc]) // PASSAGE_BYTES
        n = int(poffs[-1])
        size = np.bincount(home, minlength=n).astype(np.float64)
        fine = np.bincount(home * N_FINE + _FINE[part], minlength=n * N_FINE).reshape(n, N_FINE)
        coarse = _COARSE[part]
        pair = coarse[:-1] * N_COARSE + coarse[1:]
        same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
        pairs = np.bincount(home[:-1][same] * N_COARSE**2 + pair[same], minlength=n * N_COARSE**2).reshape(n, N_COARSE**2)
        words = _word_features(part, at, home, n)
        per = np.maximum(size, 1.0)[:, None]
        features = np.concatenate([np.sqrt(fine / per), np.sqrt(pairs / per), words], 1).astype(np.float32)
        yield lo, hi, features, poffs


def _word_features(part: np.ndarray, at: np.ndarray, home: np.ndarray, n: int) -> np.ndarray:
    starts, ends, woffs = tk.word_spans(part, at, tk.NONSPACE)
    if not len(starts):
        return np.zeros((n, N_WORD))
    where, length = home[starts], (ends - starts).astype(np.float64)
    hashes = tk.word_hashes(part, starts, ends)
    doc = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
    key = hashes ^ tk.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(key), bool)
    seen[order[1:]] = key[order[1:]] == key[order[:-1]]
    repeat = np.zeros(len(key), bool)
    repeat[1:] = key[1:] == key[:-1]
    count = np.bincount(where, minlength=n).astype(np.float64)
    total = lambda x: np.bincount(where, weights=x, minlength=n)
    per = np.maximum(count, 1.0)
    mean = total(length) / per
    spread = np.sqrt(np.maximum(total(length * length) / per - mean * mean, 0))
    return np.stack([mean / 8, spread / 8, total(seen) / per, total(repeat) / per, total(length > 14) / per, np.log1p(count) / 5], 1)


@dataclass
class Model:
    """Parameters of the network; ``score`` is its forward pass over bags."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, features: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) * self.scale, -CLIP, CLIP)
        return _forward(self.weights, x, offs)[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, offs: np.ndarray):
    starts = offs[:-1]
    bag = np.repeat(np.arange(len(starts)), np.diff(offs))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ w["c"] + w["d"]), bag, h, t, g, a, z


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, bag, h, t, g, a, z = _forward(w, x, offs)
    dl = (p - y) / len(y)
    dz = dl[:, None] * w["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, offs[:-1])[bag])
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit by Adam on bags of passage features; deterministic for given bags in a given order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = sum(len(b) for b in bags)
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / rows
    spread = np.sqrt(np.maximum(sum(((b - mean) ** 2).sum(0) for b in bags) / rows, 0))
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    n = bags[0].shape[1]
    w = {
        "W": rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(bags)):
            order = np.concatenate([order, rng.permutation(len(bags))])
        mine, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - step / STEPS) + RATE / 20
        x = np.clip((np.concatenate([bags[i] for i in mine]) - mean) * scale, -CLIP, CLIP)
        offs = np.concatenate([[0], np.cumsum([len(bags[i]) for i in mine])])
        for k, grad in _gradients(w, x, offs, labels[mine]).items():
            grad = grad + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for _, _, features, poffs in passages(batch.column("text")):
            out += [features[a:b].astype(np.float16).tobytes() for a, b in zip(poffs[:-1], poffs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model | float:
    """A model from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    At most ``train_docs`` labelled rows (see ``training_rows``) are read, in the order
    of the md5 of the id while their texts have at most ``train_bytes`` bytes together.
    Without both classes there is nothing to learn: the share of label 1 (0.5 if
    there are no labels at all) is returned instead of a model.
    """
    bound_batches(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = training_rows(docs, labels, train_docs).withColumn("size", size).filter(F.col("size") <= train_bytes // 8)
    rows = cut(rows.withColumn("order", F.md5(F.col("doc_id").cast("string"))))
    total = F.sum("size").over(Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over train_docs narrow rows
    fitting = rows.select("doc_id", "order", "size").withColumn("total", total).filter(F.col("total") <= train_bytes).select("doc_id")
    chosen = rows.join(F.broadcast(fitting), "doc_id").select("doc_id", "label", "text")
    got = chosen.mapInArrow(released(_encode), "doc_id long, label int, bag binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["bag"]))
    y = np.array([r["label"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return train([np.frombuffer(r["bag"], np.float16).reshape(-1, N_FEATURES) for r in got], y)


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for lo, hi, features, poffs in passages(batch.column("text")):
                    out[lo:hi] = model.score(features, poffs)
            yield batch, out

    return score


def score_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text).

    A null text is empty, an empty one a single passage without counts; a text of any
    length is scored whole. Repeated rows and null ids come out as they came in, each
    scored by its own text; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scored = _scored(spark.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(run), "doc_id long, score double"
    )


def keep_good(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns (see ``keep_scored``)."""
    return keep_scored(docs, _scored(docs.sparkSession.sparkContext.broadcast(model)), lambda s: s >= threshold)


HELD_OUT = (3, 1)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``labels`` that quality may be learned from."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return labels.filter(document_remainder(HELD_OUT[0]) != HELD_OUT[1]).select("doc_id", F.col("quality").alias("label"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's score from its whole text; a null id is not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_quality(docs, fit(docs, training_labels(spark, sf_dir)))
    held = F.coalesce(document_remainder(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

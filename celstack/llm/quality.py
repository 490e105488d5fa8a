"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (fixed windows of its UTF-8 bytes, over the whole text). Every passage is encoded from hashed
byte trigrams and byte-class shares; gated attention weights, learned from document labels alone, combine the passage
encodings into one representation that a logistic output scores. Nothing but the text enters a score.

Fitting uses a bounded sample: at most ``per_class`` labelled rows of each class, chosen by a hash of the id, and of each such
document at most ``fit_passages`` passages spread evenly over it. Scoring has no such bound: it reads every passage.

Defined cases: null and empty texts are a bag of one zero passage; a null or repeated id is scored row by row; of repeated
labels of one id the smallest non-null counts; without labels of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, utf8

WINDOW = 512
BUCKETS = 256
SHRINK = 48
HIDDEN = 32
GATE = 16


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 7, np.int64)
    kinds[:128] = 6
    for kind, low, high in ((0, 97, 122), (1, 65, 90), (2, 48, 57), (3, 32, 32), (4, 9, 13)):
        kinds[low : high + 1] = kind
    kinds[list(b".,;:?'\"-()")] = 5
    return kinds


KINDS = _byte_classes()
WIDTH = BUCKETS + 11


def encode_passages(text: str | None) -> np.ndarray:
    """One float32 row of ``WIDTH`` features per passage of the whole text."""
    data = np.frombuffer(utf8(text), np.uint8)
    if not len(data):
        return np.zeros((1, WIDTH), np.float32)
    count = (len(data) - 1) // WINDOW + 1
    at = np.arange(len(data)) // WINDOW
    shares = np.bincount(at * 8 + KINDS[data], minlength=count * 8).reshape(count, 8)
    size = shares.sum(1, keepdims=True)
    wide = data.astype(np.uint32)
    if len(data) > 2:
        code = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA77)) ^ (wide[2:] * np.uint32(0xC2B2AE3D))
        bucket = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(24)).astype(np.int64)
        grams = np.bincount(at[:-2] * BUCKETS + bucket, minlength=count * BUCKETS).reshape(count, BUCKETS).astype(np.float32)
    else:
        grams = np.zeros((count, BUCKETS), np.float32)
    total = grams.sum(1, keepdims=True)
    # chance that two trigrams of the passage are equal, without the bias that short passages would have
    repeated = (grams * (grams - 1)).sum(1, keepdims=True) / np.maximum(total * (total - 1), 1)
    # short passages say little, so their features shrink towards zero
    root = np.sqrt(grams / (total + SHRINK))
    words = text.split()
    stutter = np.full((count, 1), sum(map(operator.eq, words, words[1:])) / (len(words) + 8))
    return np.hstack([root, stutter, 2 * shares / (size + SHRINK / 2), 8 * repeated * total / (total + SHRINK), np.ones((count, 1))]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Weights of the passage encoder, the gated attention and the output; ``shift`` restores the class shares of all labels."""

    encoder: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attend: np.ndarray
    output: np.ndarray
    bias: float
    shift: float = 0.0

    def attention(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention weight of each passage of one bag, and the encodings."""
        hidden = np.tanh(passages @ self.encoder)
        energy = (np.tanh(hidden @ self.tanh_gate) * _sigmoid(hidden @ self.sigmoid_gate)) @ self.attend
        weight = np.exp(energy - energy.max())
        return weight / weight.sum(), hidden

    def score(self, passages: np.ndarray) -> float:
        weight, hidden = self.attention(passages)
        return float(_sigmoid((weight @ hidden) @ self.output + self.bias + self.shift))


def constant_model(logit: float) -> AttentionModel:
    return AttentionModel(np.zeros((WIDTH, 1), np.float32), np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1), np.zeros(1), logit)


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> AttentionModel:
    """Minimise the logistic loss of bags by Adam on mini-batches; deterministic for equal input."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (WIDTH, HIDDEN)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)),
               rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    weights = [w.astype(np.float32) for w in weights]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            step += 1
            grads = _gradients(weights, [bags[i] for i in chosen], labels[chosen])
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(*weights[:5], float(weights[5][0]))


def _gradients(weights: list[np.ndarray], bags: list[np.ndarray], labels: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    encoder, tanh_gate, sigmoid_gate, attend, output, bias = weights
    x = np.vstack(bags).astype(np.float32)
    sizes = np.array([len(b) for b in bags])
    starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    hidden = np.tanh(x @ encoder)
    t, s = np.tanh(hidden @ tanh_gate), _sigmoid(hidden @ sigmoid_gate)
    energy = (t * s) @ attend
    weight = np.exp(energy - np.maximum.reduceat(energy, starts)[of])
    weight /= np.add.reduceat(weight, starts)[of]
    value = hidden @ output
    bag_value = np.add.reduceat(weight * value, starts)
    delta = (_sigmoid(bag_value + bias) - labels) / len(bags)
    d_energy = weight * delta[of] * (value - bag_value[of])
    d_gate = d_energy[:, None] * attend
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    mixed = (weight * delta[of])[:, None]
    d_hidden = (mixed * output + d_t @ tanh_gate.T + d_s @ sigmoid_gate.T) * (1 - hidden * hidden)
    grads = [x.T @ d_hidden, hidden.T @ d_t, hidden.T @ d_s, (t * s).T @ d_energy, (mixed * hidden).sum(0), np.array([delta.sum()])]
    return [(g + decay * w).astype(np.float32) for g, w in zip(grads, weights, strict=True)]


def held_out(column: str = "doc_id") -> Column:
    """Every fifth document by crc32 of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, fit_passages: int = 32) -> AttentionModel:
    """Learn from the labelled rows that are not held out; see the module text for the bounds of the sample."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.where(~held_out())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    zeros, ones = counts.get(0, 0), counts.get(1, 0)
    prior = float(np.log((ones + 1) / (zeros + 1)))
    if not zeros or not ones:
        return constant_model(prior)
    sample = None
    for label in (0, 1):
        part = hashed_sample(known.where(F.col("label") == label), "doc_id", counts[label], per_class)
        sample = part if sample is None else sample.unionByName(part)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column("text").to_pylist():
                x = encode_passages(text)
                if len(x) > fit_passages:
                    x = x[np.linspace(0, len(x) - 1, fit_passages).astype(int)]
                bags.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    # the sample has at most 2 * per_class rows of two integers: its broadcast is bounded by a parameter
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = picked.mapInArrow(encoded, "doc_id long, label int, bag binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return constant_model(prior)
    model = fit_bags([np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in rows], y)
    model.shift = prior - float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    return model


def score_column(model: AttentionModel, column: str = "text") -> Column:
    """Score of the whole text in ``column``, between 0 and 1."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(encode_passages(t)) for t in texts.to_pylist()], pa.float64())

    return scored(F.col(column))


def passage_weights(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """(doc_id, passage, weight): how much each passage counts for its document."""

    @F.arrow_udf("array<double>")
    def weights(texts: pa.Array) -> pa.Array:
        return pa.array([model.attention(encode_passages(t))[0].tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.select("doc_id", F.posexplode(weights("text")).alias("passage", "weight"))


def classify(docs: DataFrame, model: AttentionModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_accepted(docs: DataFrame, model: AttentionModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged."""
    return docs.where(score_column(model) >= threshold)

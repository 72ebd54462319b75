"""Quality classifier: hashed word n-gram logistic regression learned by FTRL.

Words and runs of symbols are the tokens; a token equal to the one before it
becomes a repetition mark, so that repetition looks alike whatever is repeated.
Unigrams and bigrams hash into a fixed number of weights. Training makes one
follow-the-regularised-leader step per document; scoring is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.labelled import fold_of, training_texts

_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
BITS = 18
#: Labelled documents that a model is fitted on, at most.
TRAINING_BOUND = 6000
#: N-grams that one document is learned from, at most: a seeded draw from the whole text.
TRAINING_GRAMS = 4096
_SAME = np.uint64(0x9E3779B1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_MEMO = 500_000


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _TokenHashes()


def ngrams(text: str | None) -> np.ndarray:
    """Hashed unigrams and bigrams of a whole text, repeats included."""
    tokens = _TOKEN.findall(text or "")
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return np.zeros(0, np.int32)
    marked = h.copy()
    marked[1:][h[1:] == h[:-1]] = _SAME
    shift = np.uint64(64 - BITS)
    one = (marked + np.uint64(1)) * _MIX >> shift
    two = (marked[:-1] * _SECOND ^ (marked[1:] + np.uint64(7)) * _MIX) * _MIX >> shift
    return np.concatenate([one, two]).astype(np.int32)


def fit_ftrl(
    rows: list[np.ndarray], labels: np.ndarray, *, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 10
) -> np.ndarray:
    """Weights by FTRL-proximal; the last one is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, count = np.unique(rows[i], return_counts=True)
            index = np.append(index, size - 1)
            value = np.append(count / np.sqrt(max(1, len(rows[i]))), 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - labels[i]) * value
            z[index] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def dot(weights: np.ndarray, row: np.ndarray) -> float:
    return float(weights[row].sum(dtype=np.float64) / np.sqrt(max(1, len(row))) + weights[-1])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_BOUND) -> np.ndarray:
    """Fit on at most ``bound`` labelled documents; n-grams come from the executors.

    The driver gets ``bound`` times ``TRAINING_GRAMS`` numbers of four bytes at
    most (98 MB), however long the texts are.
    """

    def drawn(doc_id: int, text: str | None) -> np.ndarray:
        found = ngrams(text)
        if len(found) <= TRAINING_GRAMS:
            return found
        return np.random.default_rng(doc_id & 0xFFFFFFFF).choice(found, TRAINING_GRAMS, replace=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([drawn(*r) for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams, batch.column(2)], ["doc_id", "grams", "label"])

    texts = training_texts(docs, labels, label, bound).select("doc_id", "text", "label")
    table = texts.mapInArrow(run, "doc_id bigint, grams array<int>, label int").toArrow().sort_by("doc_id")
    rows = [np.asarray(r.values) for r in table["grams"]]
    return fit_ftrl(rows, table["label"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null, empty and blank texts have no n-grams and score as the bias alone.
    Without a labelled row outside fold 0 every score is one half. Repeated
    rows score alike, an empty table gives an empty one, other columns are
    ignored. One pass without a shuffle; the model (1 MB, fixed) is broadcast.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    known = labels.select(labels["doc_id"], labels[label].alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(source, known, "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            z = np.array([dot(weights, ngrams(t)) for t in batch.column(1).to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scores = source.mapInArrow(run, "doc_id bigint, score double")
    return scores.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

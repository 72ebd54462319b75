"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length. Filters of several
widths slide over a window's bytes, each keeps its largest response in the
window, and a softmax layer turns these into language probabilities. A text's
probabilities are the means over all its windows. Everything is numpy: training
on a bounded set of labelled windows, inference on batches of windows with the
filters of neighbouring byte pairs folded into look-up tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.labelled import fold_of
from oreline.storage import written

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents per language and of all languages, about, and windows of each, at most.
DOCS_PER_LANGUAGE, TRAINING_DOCS, WINDOWS_PER_DOC = 500, 20_000, 8
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 512


def windows_of(text: str) -> np.ndarray:
    """All windows of a text's bytes, the last one filled up with spaces."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """Filters by width (place in the filter, byte, filter), biases, softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    _pairs: list = field(default_factory=list, repr=False)

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter responses of width k at every place of every window."""
        w = self.filters[k]
        places = x.shape[1] - len(w) + 1
        total = np.take(w[0], x[:, :places], axis=0)
        for j in range(1, len(w)):
            total += np.take(w[j], x[:, j : j + places], axis=0)
        return total + self.bias[k]

    def folded(self) -> list[list[np.ndarray]]:
        """Tables of byte pairs (and a last single byte) per width."""
        if not self._pairs:
            for w in self.filters:
                tables = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(-1, w.shape[2]).astype(np.float32) for j in range(0, len(w) - 1, 2)]
                self._pairs.append(tables + ([w[-1].astype(np.float32)] if len(w) % 2 else []))
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window; the batch is worked through in bounded parts."""
        parts = []
        for at in range(0, len(x), _BATCH):
            part = x[at : at + _BATCH]
            pair = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            pooled = []
            for w, b, tables in zip(self.filters, self.bias, self.folded()):
                places = WINDOW - len(w) + 1
                total = None
                for t, table in enumerate(tables):
                    index = pair[:, 2 * t : 2 * t + places] if len(table) > 256 else part[:, 2 * t : 2 * t + places]
                    rows = np.take(table, index, axis=0)
                    total = rows if total is None else np.add(total, rows, out=total)
                pooled.append(np.maximum(total.max(axis=1) + b, 0))
            z = np.concatenate(pooled, axis=1) @ self.dense + self.dense_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], *, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy; max pooling passes gradients to one place per filter."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    values = [*net.filters, *net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            n = len(xb)
            pooled, where = [], []
            for k in range(len(WIDTHS)):
                r = net.responses(xb, k)
                where.append(r.argmax(axis=1))
                pooled.append(np.take_along_axis(r, where[-1][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ net.dense + net.dense_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(n), yb] -= 1
            d /= n
            back = (d @ net.dense.T) * (raw > 0)
            grads_w, grads_b = [], []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads_b.append(g.sum(axis=0))
                grad = np.zeros_like(net.filters[k])
                filter_no = np.broadcast_to(np.arange(FILTERS), where[k].shape)
                for j in range(w):
                    seen = np.take_along_axis(xb, where[k] + j, axis=1)
                    np.add.at(grad[j], (seen, filter_no), g)
                grads_w.append(grad)
            step += 1
            for v, m, s, g in zip(values, first, second, [*grads_w, *grads_b, hidden.T @ d, d.sum(axis=0)]):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def fitted(docs: DataFrame) -> Network | None:
    """Train on windows of documents with a language outside fold 0.

    About ``DOCS_PER_LANGUAGE`` documents of each language, those with the
    smallest hashes of id and text, give up to ``WINDOWS_PER_DOC`` windows from
    anywhere in the text; with many languages each gives fewer, so that about
    ``TRAINING_DOCS`` are drawn (20 MB of windows). Repeated rows are drawn once.
    ``docs`` has ``doc_id, text, lang``.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id") != 0))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    languages = counts.count()
    if not languages:
        return None
    share = F.lit(min(DOCS_PER_LANGUAGE, TRAINING_DOCS / languages)) / F.col("n")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_000_000)) / 1e9
    chosen = known.join(counts, "lang").where(draw <= share).dropDuplicates(["doc_id", "text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, cut = [], [], []
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not _LETTER.search(text or ""):
                    continue
                found = windows_of(text)
                pick = np.random.default_rng(doc_id & 0xFFFFFFFF).permutation(len(found))[:WINDOWS_PER_DOC]
                ids += [doc_id] * len(pick)
                langs += [lang] * len(pick)
                cut += [found[i].tobytes() for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(cut, pa.binary())], ["doc_id", "lang", "bytes"])

    table = chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, lang string, bytes binary").toArrow()
    rows = sorted(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["bytes"].to_pylist()))
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([languages.index(r[1]) for r in rows]), languages)


def identified(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    ``und`` with score 0 where the text is null or empty or has no letter (a
    letter in Unicode's sense), and where nothing could be learned. Very long
    texts are read whole, window by window. Repeated rows are predicted alike,
    an empty table gives an empty one, other columns are ignored. One pass
    without a shuffle; the network (about 150 KB) is broadcast.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            group: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush() -> None:
                if not group:
                    return
                p = net.probabilities(np.concatenate([w for _, w in group]))
                starts = np.cumsum([0, *(len(w) for _, w in group)])
                sums = np.add.reduceat(p, starts[:-1], axis=0) / np.diff(starts)[:, None]
                for (i, _), mean in zip(group, sums):
                    best = int(mean.argmax())
                    pred[i], score[i] = net.languages[best], float(min(1.0, mean[best]))
                group.clear()

            for i, value in enumerate(texts):
                if net is None or not value or not _LETTER.search(value):
                    continue
                group.append((i, windows_of(value)))
                held += len(group[-1][1])
                if held >= 4 * _BATCH:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = source.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score")

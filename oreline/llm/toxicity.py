"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

The lexicon has two parts: a short fixed list of insults and stems learned from
the labels (words and word beginnings that toxic documents hold far more often
than others). Features are densities of lexicon words, their nearness to the
second person, capitals, punctuation and obfuscated spellings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.boosting import fit_isotonic, fit_trees
from oreline.llm.labelled import fold_of, training_texts
from oreline.storage import written

#: Labelled documents that lexicon, trees and calibration are fitted on, at most.
TRAINING_BOUND = 10_000
#: Learned stems, at most.
LEXICON_BOUND = 600
# Insults and second-person words of the languages served.
INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb fool jerk bastard asshole bitch hate filth vermin idiota estúpido imbécil basura asqueroso idiote stupide crétin connard salaud ordure dégoûtant dumm dummkopf abschaum arschloch widerlich versager".split())
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SIGNS = ".,;:!?\"'()[]{}<>|*%&$#-_"
_NEAR = 6
_MEMO = 500_000
FEATURES = 18


def plain_form(word: str) -> str:
    """Lower-case word without the signs around it."""
    return _EDGE.sub("", word.lower())


def readable_form(word: str) -> str:
    """The word with digits and signs read as the letters they stand for."""
    return _INNER.sub("", _EDGE.sub("", word.lower().translate(_LEET)))


def stems(word: str) -> list[str]:
    """The whole word (marked) and its beginnings of four to seven letters."""
    return ["=" + word, *(word[:n] for n in range(4, min(8, len(word) + 1)))] if len(word) > 2 else []


class Words(dict):
    """Row number of each word; rows hold what the features need of a word."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.rows: list[tuple[float, ...]] = []
        self._table = np.zeros((0, 8), np.float32)
        self.filled = 0

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        found = max([get(s, 0.0) for s in stems(word)]) if len(word) > 2 else 0.0
        return max(found, 6.0) if word in INSULTS else found

    def described(self, word: str) -> tuple[float, ...]:
        core = word.strip(_SIGNS)
        if core.isalpha():  # most words: letters only, signs at the ends at most
            plain = core.lower()
            caps = 0 if plain == core else sum(map(str.isupper, core))
            n = len(core)
            return (self.weight(plain), 0.0, plain in SECOND_PERSON, caps, n, n > 1 and caps == n, False, len(word) - n)
        plain, readable = plain_form(word), readable_form(word)
        weight = self.weight(plain)
        hidden = self.weight(readable) if readable != plain and not weight else 0.0
        letters = sum(map(str.isalpha, word))
        caps = sum(map(str.isupper, word))
        mixed = bool(plain) and any(map(str.isalpha, plain))
        return (weight, hidden, plain in SECOND_PERSON, caps, letters, letters > 1 and caps == letters, mixed, len(word) - letters)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.rows)
        self.rows.append(self.described(word))
        return at

    def table(self, ids: np.ndarray) -> np.ndarray:
        if self.filled < len(self.rows):
            if len(self._table) < len(self.rows):
                grown = np.zeros((2 * len(self.rows), 8), np.float32)
                grown[: self.filled] = self._table[: self.filled]
                self._table = grown
            self._table[self.filled : len(self.rows)] = self.rows[self.filled :]
            self.filled = len(self.rows)
        return self._table[ids]

    def trim(self) -> None:
        if len(self.rows) >= _MEMO:
            self.clear()
            self.rows.clear()
            self.filled = 0


def features(text: str | None, words: Words) -> np.ndarray:
    """Dense features of one whole text; all zero where it has no words."""
    words.trim()
    parts = (text or "").split()
    n = len(parts)
    out = np.zeros(FEATURES, np.float32)
    if not n:
        return out
    rows = words.table(np.fromiter(map(words.__getitem__, parts), np.int64, n))
    weight, hidden = rows[:, 0], rows[:, 1]
    hit = (weight > 0) | (hidden > 0)
    hits = np.flatnonzero(hit)
    letters = max(1.0, float(rows[:, 4].sum()))
    out[0], out[1] = hits.size / n, np.log1p(hits.size)
    out[2], out[3] = float((weight + hidden).sum()) / n, float(np.log1p((weight + hidden).sum()))
    out[4] = float(np.maximum(weight, hidden).max())
    out[5] = len({parts[i].lower() for i in hits.tolist()})
    out[6], out[7] = float((hidden > 0).sum()) / n, float((hidden > 0).sum())
    second = np.concatenate([[0], np.cumsum(rows[:, 2])])
    low, high = np.maximum(0, hits - _NEAR), np.minimum(n, hits + _NEAR + 1)
    near = (second[high] - second[low]) > 0
    out[8], out[9], out[10] = near.sum() / n, near.mean() if hits.size else 0.0, second[-1] / n
    out[11], out[12] = float(rows[:, 3].sum()) / letters, float(rows[:, 5].sum()) / n
    out[13], out[14] = float(rows[:, 7].sum()) / (letters + float(rows[:, 7].sum())), float(rows[:, 6].sum()) / n
    out[15] = (text.count("!") + text.count("?")) / n
    out[16] = np.log1p(n)
    strong = np.sort(np.maximum(weight, hidden))[-3:]
    out[17] = float(strong.sum())
    return out


def _lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds of the stems that mark toxic texts, at most ``LEXICON_BOUND``.

    A stem counts once per distinct text and the counts are added up per task
    before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {plain_form(w) for w in (text or "").split()}
                (toxic if label else clean).update({s for w in seen for s in stems(w)})
        keys = list(toxic | clean)
        counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], ["stem", "toxic", "clean"])

    distinct = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    totals = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    counted = distinct.select("text", "label").mapInArrow(count, "stem string, toxic bigint, clean bigint")
    toxic_rate, clean_rate = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    odds = F.log(toxic_rate / clean_rate)
    sums = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    marked = sums.withColumn("odds", odds).where((F.col("odds") > 2.3) & (F.col("toxic") >= max(4, n_toxic * 0.01)))
    best = marked.orderBy(F.desc(F.col("odds") * F.col("toxic")), "stem").limit(LEXICON_BOUND).collect()
    return {r["stem"]: float(min(6.0, r["odds"])) for r in best}


def fitted(texts: DataFrame) -> tuple:
    """Lexicon from one part of the sample, trees from another, calibration from the rest."""
    texts = written(texts, "toxicity-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10))
    lexicon = _lexicon(texts.where(part < 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            rows = pa.array([features(t, words).astype("f8") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(2), batch.column(3)], ["doc_id", "x", "label", "part"])

    rows = texts.where(part >= 4).select("doc_id", "text", "label", part.alias("part"))
    table = rows.mapInArrow(run, "doc_id bigint, x array<double>, label int, part bigint").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return lexicon, None, None
    x = np.array(table["x"].to_pylist()).reshape(-1, FEATURES)
    y, later = table["label"].to_numpy().astype(float), table["part"].to_numpy() >= 7
    trees = fit_trees(x[~later], y[~later]) if (~later).any() else fit_trees(x, y)
    held = later if later.any() else ~later
    return lexicon, trees, fit_isotonic(trees.margin(x[held]), y[held])


def scored(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = 0.5, bound: int = TRAINING_BOUND) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null, empty and blank texts have all features zero and score as the model
    says of that. Without a labelled row outside fold 0 every score is zero.
    Repeated rows score alike, an empty table gives an empty one, other columns
    are ignored. Scoring is one pass without a shuffle; the model (under 1 MB)
    is broadcast. The sample that is fitted on has at most ``bound`` documents.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    known = labels.select(labels["doc_id"], labels[label].alias("label"))
    sample = training_texts(source, known, "label", bound).select("doc_id", "text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees, steps = shared.value
        words = Words(lexicon)
        for batch in batches:
            x = np.array([features(t, words) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, FEATURES)
            score = np.interp(trees.margin(x), *steps) if trees else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scores = source.mapInArrow(run, "doc_id bigint, score double")
    return scores.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

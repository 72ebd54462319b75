"""Quality rules on tokeniser fertility, with rejection bands per language or script.

A public subword vocabulary spends few tokens on text like that it was made
for and many on symbol noise, table debris or broken encodings. Three measures
of a text's tokens are taken: characters per token, the share of byte-fallback
tokens, and token entropy. Words with a digit (numbers, addresses, keys) would
move a language's medians, so they are measured apart: the plain words, the
words with a digit and the whole text each have byte share and entropy, the
first two characters per token, and the digit words' share of the text is a
measure too. Bands come from the corpus, per language
or else script: the median of its characters per token and the median deviation from
it, scaled by the root of the token count, since short texts scatter more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.sentencepiece_bpe import Codec, Vocabulary, codec_of, default_model
from oreline.llm.rows import column, packed, schema_with, unpacked
from oreline.storage import written

_DIGIT = re.compile(r"\d")
_WITH_DIGIT = re.compile(r"(?<!\S)(?=\S*\d)(\S+)\s?")
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
#: First code point of a script's main block, in order.
_SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x2000, "Other"), (0x3040, "Japanese"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
)

#: Texts with fewer tokens than this have no verdict of their own.
MIN_TOKENS = 40
#: A language with fewer measured documents takes its script's bands, a script those of all documents.
MIN_DOCUMENTS = 50
#: Rejected: characters per token this many scaled deviations, and this share, below the median.
LOW_DEVIATIONS, LOW_SHARE = 3.5, 0.04
#: Rejected: byte-fallback share this far above the language's median share.
BYTE_MARGIN = 0.25
#: Rejected: words with a digit that hold this much more of the text's letters and signs than the median
#: share, plus one over the root of the word count, since short texts scatter more.
DIGIT_MARGIN = 0.5
#: Rejected: entropy below this share of the largest possible for the count.
LOW_ENTROPY = 0.25
_BIN = 1e-3


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """Number of the block of each letter of the basic plane; one more for what is no letter."""
    points = np.arange(1 << 16)
    block = np.searchsorted([s for s, _ in _SCRIPTS], points, side="right") - 1
    letters = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    return np.where(letters, block, len(_SCRIPTS)).astype(np.int8)


def script_of(text: str) -> str:
    """The script of most letters of a text; ``None`` if it has none."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "None"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if int(points.max()) >> 16:
        return script_of_rare(text)
    return _most(np.bincount(_script_table()[points], minlength=len(_SCRIPTS) + 1)[:-1])


def script_of_rare(text: str) -> str:
    """The same for texts with characters beyond the basic plane."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "surrogatepass"), "<u4")
    return _most(np.bincount(np.searchsorted([s for s, _ in _SCRIPTS], points, side="right") - 1, minlength=len(_SCRIPTS)))


def _most(of_block: np.ndarray) -> str:
    counts: dict[str, int] = {}
    for (_, name), n in zip(_SCRIPTS, of_block.tolist()):
        counts[name] = counts.get(name, 0) + n
    if counts["Japanese"]:  # Japanese text is Han characters among its own
        counts["Japanese"] += counts.pop("Han")
    return max(counts, key=lambda k: (counts[k], k)) if any(counts.values()) else "None"


def repeated_words(ids: np.ndarray, n_ids: int, window: int = 5) -> int:
    """Words inside windows that occur twice or more; exact, by one number per window.

    ``ids`` are below ``n_ids``. Where the windows have no place in 63 bits, ever
    wider ones are ranked by (left part, right part).
    """
    if len(ids) <= window:
        return 0
    if n_ids**window < 1 << 63:
        key = ids[: len(ids) - window + 1].copy()
        for step in range(1, window):
            key *= n_ids
            key += ids[step : len(ids) - window + 1 + step]
    else:
        key, width = ids, 1
        while width < window:
            step = min(width, window - width)
            key = np.unique(key[: len(key) - step] * (int(key.max()) + 1) + key[step:], return_inverse=True)[1]
            width += step
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hits = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    inside = np.zeros(len(ids), bool)
    for step in range(window):
        inside[hits + step] = True
    return int(inside.sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and repeated words."""
    words = text.encode("utf-8", "surrogatepass").split()
    index = dict(zip(dict.fromkeys(words), count()))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(index)),
    )


def _of_tokens(codec: Codec, ids: np.ndarray) -> tuple[int, float, float]:
    """Token count, byte-fallback share and relative entropy of the ids of a text."""
    total = len(ids)
    if not total:
        return 0, 0.0, 0.0
    ids = np.sort(ids)
    last = np.ones(total, bool)
    np.not_equal(ids[1:], ids[:-1], out=last[:-1])
    ends = np.flatnonzero(last)
    counts = ends.copy()
    counts[1:] -= ends[:-1]
    counts[0] += 1
    is_byte = codec.is_fallback[ids[ends]]  # line ends are no fallback
    share = counts / total
    return total, int(counts[is_byte].sum()) / total, float(-(share * np.log2(share)).sum()) / math.log2(max(2, total))


def token_measures(codec: Codec, text: str) -> tuple:
    """Measures of the whole text, its plain words and its words with a digit.

    Each part has token count, byte-fallback share and relative entropy, the
    last two also characters per token; at the end stands the digit words'
    share of the characters that are not blank.
    """
    digits = _WITH_DIGIT.findall(text) if _DIGIT.search(text) else []
    parts = [_WITH_DIGIT.sub("", text), " ".join(digits)] if digits else [text]
    ids = [np.frombuffer(codec.body(part), "<u4") for part in parts]
    found = [_of_tokens(codec, x) for x in ids]
    each = [v for part, f in zip(parts, found) for v in (*f, len(part) / f[0] if f[0] else 0.0)]
    if not digits:
        return (*found[0], *each, 0, 0.0, 0.0, 0.0, 0.0)
    of_digits = sum(map(len, digits))
    return (*_of_tokens(codec, np.concatenate(ids)), *each, of_digits / (of_digits + len("".join(parts[0].split()))))


_MEASURES = (
    "text_script string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, byte_share double, entropy double, "
    "plain_tokens bigint, plain_byte_share double, plain_entropy double, chars_per_token double, "
    "digit_tokens bigint, digit_byte_share double, digit_entropy double, digit_chars_per_token double, digit_share double"
)


def measures(docs: DataFrame, model_path: str | None = None, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the base and token measures of every whole text; one pass, no shuffle.

    The measures replace input columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))
    fields = [f.split()[0] for f in _MEASURES.split(", ")]
    source = packed(docs.drop(*(c for c in fields if c in docs.columns and c not in (text, lang))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            rows = []
            for value in batch.column(0).field(text):
                value = value.as_py() or ""
                rows.append((script_of(value), *base_measures(value), *token_measures(codec, value)))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            types = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.split()[1]] for f in _MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["row", *fields])

    return unpacked(source.mapInArrow(run, schema_with(source, _MEASURES)), **{f: F.col(f) for f in fields})


def _medians(counts: DataFrame) -> DataFrame:
    """``key, measure, n, at``: exact lower medians from counts ``n`` per ``bin``."""
    return counts.groupBy("key", "measure").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins")).select(
        "key",
        "measure",
        "n",
        F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda acc, b: F.struct(
                (acc["seen"] + b["n"]).alias("seen"),
                F.coalesce(acc["at"], F.when(2 * (acc["seen"] + b["n"]) >= F.col("n"), b["bin"])).alias("at"),
            ),
        )["at"].alias("at"),
    )


#: Measures with a band and the tokens they are taken over; a spread is kept of the first ones.
_SPREAD = (("chars_per_token", "plain_tokens"), ("digit_chars_per_token", "digit_tokens"))
_BYTES = (("byte_share", "n_tokens"), ("plain_byte_share", "plain_tokens"), ("digit_byte_share", "digit_tokens"))
_ENTROPY = (("entropy", "n_tokens"), ("plain_entropy", "plain_tokens"), ("digit_entropy", "digit_tokens"))
_BANDED = (*_SPREAD, *_BYTES, ("digit_share", "n_tokens"))
_LEVELS = ("__language", "__script", "__all")


def _with_keys(measured: DataFrame, lang: str) -> DataFrame:
    """Keys of the three levels of bands that a document may take."""
    language = F.when(F.col(lang).isNotNull(), F.concat(F.lit("language "), F.col(lang).cast("string")))
    return measured.withColumns({"__language": language, "__script": F.concat(F.lit("script "), F.col("text_script")), "__all": F.lit("all")})


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """``key`` and, per banded measure, its middle and spread, over all documents.

    There is a row per language, per script and one of all documents. Except in
    that last one, a measure that fewer than ``MIN_DOCUMENTS`` documents have is
    null. Medians are exact on bins of a thousandth, so reruns agree; the bins
    are counted before they meet, and a key has a few thousand at most.
    """
    keyed = _with_keys(measured, lang)
    values = F.filter(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.col(t).alias("tokens")) for m, t in _BANDED)), lambda v: v["tokens"] >= MIN_TOKENS)
    usable = keyed.select(*_LEVELS, F.explode(values).alias("v")).select(*_LEVELS, "v.*")
    counts = usable.groupBy(*_LEVELS, "measure", F.floor(F.col("value") / _BIN).alias("bin")).agg(F.count("*").alias("n"))
    per_key = counts.withColumn("key", F.explode(F.array(*_LEVELS))).where("key is not null").groupBy("key", "measure", "bin").agg(F.sum("n").alias("n"))
    middles = written(_medians(per_key).select("key", "measure", "n", (F.col("at") * _BIN).alias("middle")), "fertility-middles")
    spreadable = [m for m, _ in _SPREAD]
    around = usable.where(F.col("measure").isin(spreadable)).withColumn("key", F.explode(F.array(*_LEVELS))).where("key is not null").join(middles.drop("n"), ["key", "measure"])
    deviation = F.least(F.lit(50.0), F.abs(F.col("value") - F.col("middle")) * F.sqrt("tokens"))
    spreads = _medians(around.groupBy("key", "measure", F.floor(deviation / _BIN).alias("bin")).agg(F.count("*").alias("n"))).select("key", "measure", (F.col("at") * _BIN).alias("spread"))
    enough = (F.col("n") >= MIN_DOCUMENTS) | (F.col("key") == "all")
    known = middles.join(spreads, ["key", "measure"], "left").where(enough)
    wide = [F.max(F.when(F.col("measure") == m, F.col("middle"))).alias(f"__middle_{m}") for m, _ in _BANDED]
    wide += [F.max(F.when(F.col("measure") == m, F.col("spread"))).alias(f"__spread_{m}") for m in spreadable]
    return known.groupBy("key").agg(*wide)


def _with_bands(measured: DataFrame, lang: str) -> DataFrame:
    """Every row with the bands of its language, else its script, else of all documents."""
    band = written(bands(measured, lang), "fertility-bands")
    names = [c for c in band.columns if c != "key"]
    out = _with_keys(measured.drop(*_LEVELS, *names, *(level + c for level in _LEVELS for c in names)), lang)
    for level in _LEVELS:
        out = out.join(band.select(F.col("key").alias(level), *(F.col(c).alias(level + c) for c in names)), level, "left")
    return out.withColumns({c: F.coalesce(*(F.col(level + c) for level in _LEVELS)) for c in names}).drop(*_LEVELS, *(level + c for level in _LEVELS for c in names))


def judged(docs: DataFrame, model_path: str | None = None, *, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """Every row with its measures and verdict: ``base_failed``, ``reason``, ``kept``.

    Null, empty and blank texts have no words and fail the base rules. Texts
    with fewer than ``MIN_TOKENS`` tokens are judged by the base rules alone.
    A language with fewer than ``MIN_DOCUMENTS`` measured documents, or none,
    takes the band of the text's script, and a script as rare the band of all
    documents. Repeated rows are judged alike, very
    long texts whole; an empty table gives an empty one; added columns replace
    input columns of the same names, as do names in ``__middle_``, ``__spread_`` and of
    the band levels; others pass through. The bands table has
    one row per language and script; only the vocabulary is broadcast by this
    module, the bands where Spark sees fit. Without ``keep_text`` the text is left
    out of the result and of the table written between the two passes.
    """
    every = measures(docs, model_path, text=text, lang=lang)
    measured = written(every if keep_text else every.drop(text), "fertility")

    def low(measure: str, tokens: str) -> Column:
        middle, spread = F.col(f"__middle_{measure}"), F.col(f"__spread_{measure}")
        deviation = (F.col(measure) - middle) * F.sqrt(tokens)
        return (F.col(tokens) >= MIN_TOKENS) & (deviation < -LOW_DEVIATIONS * 1.4826 * spread) & (F.col(measure) < (1 - LOW_SHARE) * middle)

    def above(measure: str, tokens: str, margin: Column) -> Column:
        return (F.col(tokens) >= MIN_TOKENS) & (F.col(measure) > F.col(f"__middle_{measure}") + margin)

    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reason = F.when(base, "base")
    for measure, tokens in _SPREAD:
        reason = reason.when(low(measure, tokens), measure)
    for measure, tokens in _BYTES:
        reason = reason.when(above(measure, tokens, F.lit(BYTE_MARGIN)), measure)
    for measure, tokens in _ENTROPY:
        reason = reason.when((F.col(tokens) >= MIN_TOKENS) & (F.col(measure) < LOW_ENTROPY), measure)
    reason = reason.when(above("digit_share", "n_tokens", DIGIT_MARGIN + 1 / F.sqrt("n_words")), "digit_share")
    joined = _with_bands(measured, lang)
    added = joined.withColumns({"base_failed": base, "reason": reason}).withColumn("kept", F.col("reason").isNull())
    return added.drop(*(c for c in joined.columns if c.startswith(("__middle_", "__spread_"))))


def accepted(docs: DataFrame, model_path: str | None = None, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their own columns, whatever their names."""
    return unpacked(judged(packed(docs, text=column(text), lang=column(lang)), model_path, keep_text=False).where("kept"))

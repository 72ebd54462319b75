"""Personal data in text: exact patterns, and a conditional random field for the rest.

The base patterns find e-mail and IP addresses, card and phone numbers in their
usual spellings. A linear-chain field over word shapes, trained from a small
labelled table, adds spans in unusual spellings (``name [at] host [dot] com``,
``(555) 123-4567``, ``10[.]0[.]0[.]1``, dotted card numbers). What it marks must
pass the kind's own check (Luhn, number ranges, digit counts; any ending of an
e-mail host, but a listed one where at or dot are bare words) and may not touch
a base span; base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm import crf
from oreline.llm.rows import column, fresh, packed, schema_with, unpacked

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{place}-{kind}" for kind in KINDS for place in "BI")]

# Linear forms of the base patterns: no start is tried inside a run that was passed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the last match ended
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the base patterns, by start and then kind as listed."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


# Words that announce or spell out personal data.
_CUES = frozenset("at dot tel tel: phone phone: call fax mobile email e-mail mail mail: email: write contact reach card card: visa ip ip: host server arobase arroba punto point punkt telefon teléfono téléphone [at] (at) {at} [dot] (dot) {dot} . [.]".split())
_TLDS = frozenset("com org net edu gov io info de fr es uk eu".split())
_OTHER_TLDS = tuple("ch at ca mx it nl dev be se pl jp app museum".split())  # in the labelled table only
_COMMON = frozenset("the a an this that it is was look he she we they and or of le la les un une der die das el los una".split())
_OUTER = ",;:!?\"'<>|"
_SPLIT_AT = re.compile(r"\s*(?:[\[({]\s*(?:at|arroba|arobase)\s*[\])}]|\s(?:at|arroba|arobase)\s|@)\s*", re.I)
_SPLIT_DOT = re.compile(r"\s*(?:[\[({]\s*(?:dot|punto|point|punkt|\.)\s*[\])}]|\s(?:dot|punto|point|punkt)\s|\.)\s*", re.I)


_BARE_AT = re.compile(r"\s(?:at|arroba|arobase)\s", re.I)
_BARE_DOT = re.compile(r"\s(?:dot|punto|point|punkt)\s", re.I)


_LONG_RUN = re.compile("d{5,}")


def shape(word: str) -> str:
    """Letters as x or X and digits as d, runs shortened, signs kept."""
    out: list[str] = []
    for ch in word:
        kind = "d" if ch.isdigit() else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if kind == "d" or not out or out[-1] != kind:
            out.append(kind)
    return _LONG_RUN.sub("d+", "".join(out))


_RUN = re.compile(r"d\+?d*")
_LETTERS = re.compile(r"[^\W\d_]+[.,]?")


def describe(word: str) -> tuple[str, ...]:
    """Features of one word, from its shape and a few fixed word lists."""
    low = word.lower()
    if _LETTERS.fullmatch(word) and low not in _CUES and low.rstrip(".,") not in _TLDS:
        return ("plain",)
    core = word.strip(_OUTER).rstrip(".") or word
    digits = sum(map(str.isdigit, core))
    form = shape(core)
    found = ["shape=" + form, "loose=" + _RUN.sub("d", form), f"digits={min(digits, 20) // 2 if digits < 8 else 4 + digits // 4}"]
    if low in _CUES or low.strip(_OUTER) in _CUES:
        found.append("cue=" + low.strip(_OUTER))
    if core.lower().rsplit(".", 1)[-1] in _TLDS:
        found.append("tld")
    if core != word:
        found.append("edge=" + word[-1] if word[-1:] in ",.;:!?" else "edge")
    found += [f"has={s}" for s in ("@", "[at]", "(at)", "[.]", "(.)", "[dot]", "(dot)") if s in core.lower()]
    return tuple(found)


# The small labelled table: templates with slots, filled by a seeded rule.
_CARRIERS = (
    "{s}", "please {c} {s} now", "the {c} {s} , thanks", "we met {f} and {s} was there", "{f} {s} {f}", "{c} {s}", "{c} : {s} .",
    "{f} {f} {c} {s} {f} {f}", "my {c} is {s} and that is all",
)
_CUE_OF = {"email": "email mail write contact reach", "ip": "ip host server", "card": "card visa", "phone": "tel phone call fax mobile"}
_FORMS = {
    "email": ("{n} [at] {h} [dot] {t}", "{n} (at) {h} (dot) {t}", "{n} at {h} dot {t}", "{n} [at] {h}.{t}", "{n} (at) {h}.{t}", "{n}[at]{h}[dot]{t}", "{n}(at){h}.{t}", "{n}@{h}.{t}", "{n}.{d2}@{h}.{t}"),
    "ip": ("{o}[.]{o}[.]{o}[.]{o}", "{o}(.){o}(.){o}(.){o}", "{o} . {o} . {o} . {o}", "{o} [.] {o} [.] {o} [.] {o}", "{o}.{o}.{o}.{o}"),
    "card": ("{d4}.{d4}.{d4}.{d4}", "{d4}/{d4}/{d4}/{d4}", "{d4}_{d4}_{d4}_{d4}", "{d4} {d4} {d4} {d4}", "{d4}-{d4}-{d4}-{d4}", "{d4}{d4}{d4}{d4}"),
    "phone": ("({d3}) {d3}-{d4}", "({d3}) {d3} {d4}", "{d3}-{d3}-{d4}", "{d3}.{d3}.{d4}", "1-{d3}-{d3}-{d4}", "0{d3} {d3} {d4}", "+1 ({d3}) {d3}-{d4}", "+{d2} {d3} {d3} {d4}"),
}
_OTHER = (
    "{f} at {f} {f}", "look at the dot on {f}", "on 20{d2}-{d2}-{d2} at {d2}:{d2}", "version {d1}.{d1}.{d1} of {f}", "version {d1}.{d1}", "page {d2} of {d3}",
    "isbn 978-{d1}-{d2}-{d4}{d2}-{d1}", "section {d1}.{d1}.{d1} , {f}", "price {d1},{d3}.{d2} {f}", "he is at home at {d1} in {f}", 'token = "{x}" {f}', "password={x} {f}",
    "{f}*** {f}%%% {f}$$$", "{f} | {f} | {d3} | {f}", "{d4} {f} {d4} {f}", "from {d4} to {d4}", "{f}, {f}; {f}!", "{f} dot {f} point {f}", "call {f} at {d2}", "mail {f} and write {f}",
    "item {d3}-{d2} , lot {d4}", "{d3} {d3} {f}", "ratio {d1}/{d2} {f}", "visa card and phone of {f}", "server at {f} host", "{f} . {f} . {f}", "{d2}.{d2}.20{d2} {f}", "{f} {f} {f} {f} {f} {f}",
)


_ENDINGS = (*sorted(_TLDS), *_OTHER_TLDS)


def labelled_table(rows: int = 420, seed: int = 1) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label); one in two holds no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(a, b))))

    def fill(form: str) -> str:
        def slot(m: re.Match) -> str:
            return {"d": lambda: digit(int(m[2] or 1)), "o": lambda: str(rng.integers(0, 256)), "n": lambda: letters(3, 9), "h": lambda: letters(3, 9), "t": lambda: pick(_ENDINGS),
                    "x": lambda: "".join(pick("0123456789abcdef") for _ in range(20)), "f": lambda: pick(("the", "and", "Of", "tion", letters(2, 10), letters(4, 8).title(), letters(3, 9) + "."))}[m[1]]()

        return re.sub(r"\{([a-z])(\d?)\}", slot, form)

    table = []
    for i in range(rows):
        if i % 2:
            table.append([(w, "O") for w in fill(pick(_OTHER)).split()])
            continue
        kind = KINDS[i // 2 % 4]
        before, after = pick(_CARRIERS).replace("{c}", pick(_CUE_OF[kind].split())).split("{s}")
        inside = fill(pick(_FORMS[kind])).split()
        row = [(w, "O") for w in fill(before).split()]
        row += [(w, ("B-" if j == 0 else "I-") + kind) for j, w in enumerate(inside)]
        table.append(row + [(w, "O") for w in fill(after).split()])
    return table


@lru_cache(maxsize=1)
def fitted() -> crf.Model:
    """The model of the built-in table; it depends on nothing else, so once per process."""
    return crf.fit(labelled_table(), describe, LABELS)


def passes(kind: str, text: str) -> bool:
    """The exact check of a span that the field marked."""
    if kind == "email":
        parts = _SPLIT_AT.split(text)
        host = [p for p in _SPLIT_DOT.split(parts[-1])] if len(parts) == 2 else []
        clean = all(re.fullmatch(r"[A-Za-z0-9-]+", p) for p in host) and re.fullmatch(r"[A-Za-z0-9._%+-]+", parts[0])
        named = parts[0].lower() not in _COMMON and len(host) >= 2 and host[0].lower() not in _COMMON
        if not (named and clean):
            return False
        bare = _BARE_AT.search(text) or _BARE_DOT.search(text)  # "at" and "dot" may be words of the sentence
        return host[-1].lower() in _TLDS or (not bare and re.fullmatch(r"[A-Za-z]{2,}", host[-1]) is not None)
    runs = re.findall(r"[0-9]+", text)
    digits = "".join(runs)
    if kind == "ip":
        return len(runs) == 4 and all(map(_small, runs)) and not re.search(r"[A-Za-z]", text)
    if re.search(r"[A-Za-z]", text):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(runs) >= 2


_STRIP = " \t\r\n,;:!?\"'<>|.*%&$#"
_WORDS = re.compile(r"\S+")
_TOKENS_AT_ONCE = 200_000


def _added(text: str, labels: np.ndarray, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans of marked words that pass their check and touch no base span."""
    places = [m.span() for m in _WORDS.finditer(text)]
    found, i = [], 0
    while i < len(labels):
        kind = LABELS[labels[i]][2:]
        j = i + 1
        while kind and j < len(labels) and LABELS[labels[j]] == "I-" + kind:
            j += 1
        if kind:
            raw = text[places[i][0] : places[j - 1][1]]
            start = places[i][0] + len(raw) - len(raw.lstrip(_STRIP))
            end = places[j - 1][1] - (len(raw) - len(raw.rstrip(_STRIP)))
            if passes(kind, text[start:end]) and not any(s < end and start < e for s, _, e in base):
                found.append((start, kind, end))
        i = j
    return found


class Finder:
    """Base patterns and field over batches of texts; one per Python worker."""

    def __init__(self, model: crf.Model):
        self.model, self.classes = model, crf.Classes(model, describe)
        self.ends: dict[str, bool] = {}

    def spans(self, texts: Iterable[str]) -> list[list[tuple[int, str, int, bool]]]:
        out: list[list[tuple[int, str, int, bool]]] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text) // 6
            if size >= _TOKENS_AT_ONCE:
                out += self._decoded(group)
                group, size = [], 0
        return out + self._decoded(group)

    def _decoded(self, texts: list[str]) -> list[list[tuple[int, str, int, bool]]]:
        words = [t.split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((c for w in words for c in map(self.classes.__getitem__, w)), np.int64, int(counts.sum()))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        closes = np.fromiter((w[-1] == "." for ws in words for w in ws), bool, len(ids)) & (ids == self.classes.known.get(("plain",), -1))
        starts = np.unique(np.concatenate([offsets[:-1][counts > 0], np.flatnonzero(closes) + 1]))
        labels = crf.viterbi(self.model, self.classes, ids, starts[starts < len(ids)])
        marked = np.add.reduceat(np.append(labels != 0, False), offsets[:-1]) if len(texts) else []
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            spans = [(s, k, e, True) for s, k, e in base]
            if counts[i] and marked[i]:
                spans += [(s, k, e, False) for s, k, e in _added(text, labels[offsets[i] : offsets[i + 1]], base)]
            out.append(sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))
        return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def with_spans(docs: DataFrame, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add all personal-data spans of every whole text, in code points, end exclusive.

    ``spans`` is a list of ``kind, start, end, base``, by start and then by kind
    as listed in ``KINDS``; it replaces an input column of that name. Null and
    empty texts have an empty list. Long texts are read whole and long runs of
    digits or letters take linear time. Rows are independent, so repeated rows
    repeat their result; an empty table gives an empty one. One pass, no
    shuffle; the field's weights (some 100 KB) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted())
    source = packed(docs.drop(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            found = finder.spans(t.as_py() or "" for t in batch.column(0).field(text))
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in spans_] for spans_ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], ["row", "found"])

    found = source.mapInArrow(run, schema_with(source, f"found {_SPAN_DDL}"))
    return unpacked(found, **{spans: F.col("found")})


def written_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Replace every span by its kind in angle brackets; ``n_chars`` follows.

    Spans that overlap are replaced together, under the first one's kind. Null
    texts stay null; columns and rows stay as they are.
    """
    spans = fresh("spans", docs.columns)
    found = with_spans(docs, text=text, spans=spans)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(
            s["start"] >= acc["at"],
            F.concat(acc["done"], F.substring(column(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
        ).otherwise(acc["done"])
        return F.struct(piece.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(column(text), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(column(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast("long"))
    return out.drop(spans)

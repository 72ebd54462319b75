"""Secrets in text, also where they are wrapped in escapes, base64 or compression.

The base patterns find assignments, access keys and long hexadecimal strings in
the text as it stands. A worklist then unwraps what the text holds: URL and
Unicode escapes are replaced all over a layer, base64 runs are decoded, and what
a decoded run holds compressed is expanded. Each layer is searched with the same
patterns and unwrapped in turn, until no layer gives one that has not been seen.
Every layer carries the place of its characters in the text, so a find is
reported where its encoded form stands.

Decoded bytes are read as one character each: all patterns are ASCII.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.rows import column, schema_with, unpacked

# Fixed values of the contract: kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The shortest base64 of a find: twelve characters, as in ``token=abcdef``.
SHORTEST_RUN = 16
#: Layers of escapes that are searched one by one; deeper ones are undone in one pass.
ESCAPE_ROUNDS = 32
#: Characters of a compressed layer that are held at once.
PIECE = 1 << 22
_OVERLAP = 1 << 16

_STANDARD = str.maketrans("-_", "+/")
_IN_RUN = np.zeros(256, bool)
_IN_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", np.uint8)] = True
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+")
_ESCAPE = re.compile(
    r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(amp|quot|apos|lt|gt);"
)
_NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}
_LONGEST_ESCAPE = 11


def runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of base64 characters, either alphabet, that are long enough to hold a find."""
    bad = np.flatnonzero(~_IN_RUN[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)])
    edges = np.concatenate([[-1], bad, [len(text)]])
    long = np.flatnonzero(np.diff(edges) > SHORTEST_RUN)
    return list(zip((edges[long] + 1).tolist(), edges[long + 1].tolist()))


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in _KEYWORDS)


def base_spans(text: str, found_runs: list[tuple[int, int]] | None = None) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the base patterns, by start and then kind as listed."""
    found = []
    if ("=" in text or ":" in text) and _has_keyword(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    for s, e in runs(text) if found_runs is None else found_runs:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, s, e) if m.end() - m.start() >= _LEAST["access"]]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, s, e) if m.end() - m.start() >= _LEAST["hex"]]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _may_hold(text: str) -> bool:
    """Whether decoded text can hold a find or another layer at all."""
    return _has_keyword(text) or bool(_ESCAPE.search(text)) or bool(runs(text))


@dataclass
class Layer:
    """Unwrapped text, with the place in the document of each character (or one place for all)."""

    text: str
    starts: np.ndarray | int | None  # none: the document itself
    ends: np.ndarray | int | None
    how: str = ""
    escapes: int = 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def below(self, text: str, first: np.ndarray, last: np.ndarray, how: str, escapes: int = 0) -> Layer:
        """A layer whose characters stand for this one's from ``first`` to ``last``, inclusive."""
        how = f"{self.how}>{how}" if self.how else how
        if self.starts is None:
            return Layer(text, first, last + 1, how, escapes)
        if isinstance(self.starts, int):
            return Layer(text, self.starts, self.ends, how, escapes)
        return Layer(text, self.starts[first], self.ends[last], how, escapes)

    def key(self) -> tuple:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.span(0, len(self.text))


def _plain(m: re.Match) -> str:
    """What an escape stands for; the escape itself where it stands for nothing."""
    if m[8]:
        return _NAMED[m[8]]
    code = int(m[7]) if m[7] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 else m[0]


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with all its escapes replaced once; none if it has none."""
    pieces, firsts, lasts, at = [], [], [], 0
    for m in _ESCAPE.finditer(layer.text):
        plain = _plain(m)
        if len(plain) == 1:
            kept = np.arange(at, m.start())
            pieces += [layer.text[at : m.start()], plain]
            firsts += [kept, [m.start()]]
            lasts += [kept, [m.end() - 1]]
            at = m.end()
    if not pieces:
        return None
    rest = np.arange(at, len(layer.text))
    text = "".join(pieces) + layer.text[at:]
    return layer.below(text, np.concatenate([*firsts, rest]).astype(np.int64), np.concatenate([*lasts, rest]).astype(np.int64), "escapes", layer.escapes + 1)


def _collapsed(layer: Layer) -> Layer:
    """The layer with its escapes undone until none is left, in one pass.

    A character that completes an escape with those before it is replaced at
    once, and what it becomes may complete the next.
    """
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    for i, ch in enumerate(layer.text):
        out.append(ch)
        first.append(i)
        last.append(i)
        while True:
            tail = "".join(out[-_LONGEST_ESCAPE:])
            m = next((m for m in _ESCAPE.finditer(tail) if m.end() == len(tail)), None) if out[-1] in "0123456789abcdefABCDEF;}" else None
            plain = _plain(m) if m else ""
            if len(plain) != 1:
                break
            begin = first[len(out) - len(m[0])]
            del out[len(out) - len(m[0]) :], first[len(first) - len(m[0]) :], last[len(last) - len(m[0]) :]
            out.append(plain)
            first.append(begin)
            last.append(i)
    return layer.below("".join(out), np.array(first, np.int64), np.array(last, np.int64), "escapes")


def _expanders(raw: bytes) -> Iterator[tuple[str, object]]:
    """Decompressors that the first bytes announce."""
    if raw[:2] == b"\x1f\x8b":
        yield "gzip", zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        yield "zlib", zlib.decompressobj()
    if raw[:3] == b"BZh":
        yield "bzip2", bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        yield "xz", lzma.LZMADecompressor(memlimit=1 << 28)


def _pieces(raw: bytes, expander) -> Iterator[str]:
    """What a stream expands to, in overlapping pieces; a broken stream ends where it breaks."""
    held, given = "", raw
    try:
        while not expander.eof:
            got = expander.decompress(given, PIECE)
            given = expander.unconsumed_tail if hasattr(expander, "unconsumed_tail") else b""
            held += got.decode("latin-1")
            if len(held) >= PIECE:
                cut = max(held.rfind("\n"), held.rfind(" ")) + 1 or len(held)
                yield held[:cut]
                held = held[max(0, cut - _OVERLAP) :]
            if not got and not given:
                break
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        pass
    if held:
        yield held


class Unwrapper:
    """Spans of one document after another."""

    def __init__(self, most_expanded: int):
        self.most_expanded = most_expanded

    def _decoded(self, layer: Layer, found_runs: list[tuple[int, int]]) -> Iterator[Layer]:
        """Layers of the base64 runs, and of what they hold compressed."""
        places = found_runs
        if "\n" in layer.text and found_runs:
            places = found_runs + [m.span() for m in _WRAPPED.finditer(layer.text)]
        for s, e in places:
            chars = layer.text[s:e].replace("\r", "").replace("\n", "")
            if len(chars) % 4 == 1:  # no whole number of bytes: the last character belongs to something else
                chars = chars[:-1]
            raw = base64.b64decode(chars.translate(_STANDARD) + "=" * (-len(chars) % 4))
            plain = raw.decode("latin-1")
            if _may_hold(plain):
                at = np.arange(s, e) if len(chars) >= e - s - 1 else np.array([i for i in range(s, e) if layer.text[i] not in "\r\n"])
                byte = np.arange(len(raw))
                yield layer.below(plain, at[byte * 4 // 3], at[np.minimum((byte * 8 + 7) // 6, len(chars) - 1)], "base64")
            for name, expander in _expanders(raw):
                lo, hi = layer.span(s, e)
                for piece in _pieces(raw, expander):
                    self.left -= len(piece)
                    if self.left < 0:
                        self.unread += 1
                        break
                    yield Layer(piece, lo, hi, f"{layer.how}>base64>{name}".lstrip(">"))

    def _below(self, layer: Layer, found_runs: list[tuple[int, int]]) -> Iterator[Layer]:
        if "%" in layer.text or "\\" in layer.text or "&" in layer.text:
            child = _unescaped(layer)
            if child is not None:
                yield child if layer.escapes < ESCAPE_ROUNDS else _collapsed(layer)
        yield from self._decoded(layer, found_runs)

    def spans(self, text: str) -> tuple[list[tuple[int, str, int, bool, str]], int]:
        """``start, kind, end, base, layers`` of a text, and how many layers were too large to be read."""
        self.left, self.unread = self.most_expanded, 0
        root = Layer(text, None, None)
        found_runs = runs(text)
        found = {(s, k, e): (True, "") for s, k, e in base_spans(text, found_runs)}
        seen, work = {root.key()} if found_runs or "%" in text or "\\" in text or "&" in text else set(), deque([(root, found_runs)])
        while work:
            layer, found_runs = work.popleft()
            for child in self._below(layer, found_runs):
                if not child.text or (key := child.key()) in seen:
                    continue
                seen.add(key)
                below = runs(child.text)
                for s, kind, e in base_spans(child.text, below):
                    lo, hi = child.span(s, e)
                    found.setdefault((lo, kind, hi), (False, child.how))
                work.append((child, below))
        return sorted(((s, k, e, *v) for (s, k, e), v in found.items()), key=lambda x: (x[0], KINDS.index(x[1]), x[2])), self.unread


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string())]))
_SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,layers:string>>"


def with_secrets(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] | None = None, most_expanded: int = 1 << 30) -> DataFrame:
    """Columns of every row (those in ``keep``; none: all), ``spans`` and ``n_unread``.

    ``spans`` lists ``kind, start, end, base, layers`` in code points, end
    exclusive, by start, kind as listed in ``KINDS`` and end. Base finds have
    ``base`` set; the others name the layers that hid them and cover their
    encoded form: escapes and base64 to the character, compressed data as its
    whole base64 run. A place that several layers give is listed once. Both
    columns replace an input's of these names.

    Null and empty texts have no spans. Texts are read whole in linear time for
    a bounded depth; escapes nested over ``ESCAPE_ROUNDS`` deep are undone
    together and searched once more. Compressed data is expanded piece by piece;
    a document whose compressed layers grow past ``most_expanded`` characters
    counts the layers it did not read on in ``n_unread``, against bombs. Rows
    are independent; an empty table gives an empty one. One pass, no shuffle.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("spans", "n_unread")]
    source = docs.select(F.struct(*map(column, kept)).alias("row"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unwrapper = Unwrapper(most_expanded)
        for batch in batches:
            results = [unwrapper.spans(t.as_py() or "") for t in batch.column(1)]
            rows = [[{"kind": k, "start": s, "end": e, "base": b, "layers": how} for s, k, e, b, how in spans] for spans, _ in results]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN), pa.array([n for _, n in results], pa.int64())], ["row", "found", "unread"])

    schema = schema_with(source.select("row"), f"found {_SPAN_DDL}, unread bigint")
    return unpacked(source.mapInArrow(run, schema), spans=F.col("found"), n_unread=F.col("unread"))


def written_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

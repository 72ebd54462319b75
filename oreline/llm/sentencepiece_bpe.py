"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A greedy merge encoder repeatedly joins the best-scored adjacent pair. Its
result is the only segmentation whose every adjacent pair of tokens would be
left alone if the two were merged again from characters. That turns encoding
into a left-to-right search:

* an Aho-Corasick automaton gives the longest piece that starts at each place;
* a candidate is accepted if re-merging it with the token before it gives the
  same two tokens back (answers are remembered per pair);
* otherwise the next shorter piece is tried, and when none is left the last
  token is taken back and the place is marked in a bitfield as failed, so no
  later attempt ends there again.

No piece of the vocabulary has a space mark behind another character, so text
falls apart at ``space marks + other characters`` and merges never cross those
borders; each distinct chunk is encoded once per Python worker. Nor do merges
cross two characters that stand side by side in no piece: a chunk that ends so
(a word and its comma) is put together from its parts. Characters outside the vocabulary are borders as well and become one byte piece per byte.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
BOS, EOS = 1, 2
EDGES = struct.pack("<2I", BOS, EOS)
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Distinct chunks, and token pairs, that one Python worker remembers.
MEMO_ENTRIES, PAIR_ENTRIES = 400_000, 200_000


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: normal pieces with scores, byte pieces."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a merge-type model with byte fallback (about 0.5 MB)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError(f"{path} has no byte fallback")
        pieces = tuple(
            (sp.id_to_piece(i), i, sp.get_score(i))
            for i in ids
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        )
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in pieces):
            raise ValueError(f"{path} has pieces that cross chunk borders")
        return cls(pieces, tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder over one vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.id_of = {p: i for p, i, _ in vocabulary.pieces}
        self.score = {p: s for p, _, s in vocabulary.pieces}
        self.text_of = {i: p for p, i, _ in vocabulary.pieces}
        self.byte_ids = vocabulary.byte_ids
        self.alphabet = frozenset(p for p in self.id_of if len(p) == 1)
        self.bytes_of = {p: struct.pack("<I", i) for p, i in self.id_of.items()}
        #: Characters that stand side by side in some piece; no merge crosses any other two.
        self.adjacent = frozenset(p[i : i + 2] for p in self.id_of for i in range(len(p) - 1))
        #: The longest piece that is a proper prefix of a piece, or "".
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), "") for p in self.id_of}
        self.matcher = ahocorasick.Automaton()
        for piece in self.id_of:
            self.matcher.add_word(piece, (piece, len(piece) - 1))
        self.matcher.make_automaton()
        #: Bytes by id; control ids have none.
        size = 1 + max(*self.byte_ids, *self.text_of)
        self.is_fallback = np.zeros(size, bool)  # pieces of single bytes but the line end
        self.is_fallback[[i for b, i in enumerate(self.byte_ids) if b != 10]] = True
        self.raw = [self.text_of.get(i, "").replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self._pairs: dict[tuple[str, str], bool] = {}
        self._chunks: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain greedy merging from characters: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether re-merging the two tokens gives exactly these two back."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            known = self.merged(left + right) == [left, right]
            self._pairs[left, right] = known
        return known

    def segment(self, text: str) -> list[str]:
        """Backtracking search over text whose every character is a piece."""
        n = len(text)
        longest = [""] * n
        for end, (piece, more) in self.matcher.iter(text):
            longest[end - more] = piece  # ends grow, so the last one is the longest
        pairs, shorter, failed, at = self._pairs, self.shorter, 0, 0
        tokens: list[str] = []
        last, candidate = "", longest[0]
        while True:
            end = at + len(candidate)
            if not (failed and failed >> end & 1):
                fits = pairs.get((last, candidate)) if at else True
                if fits or fits is None and self.compatible(last, candidate):
                    tokens.append(candidate)
                    if end == n:
                        return tokens
                    at, last, candidate = end, candidate, longest[end]
                    continue
            candidate = shorter[candidate]
            while not candidate:  # nothing fits here: take the last token back
                failed |= 1 << at
                taken = tokens.pop()
                at -= len(taken)
                last = tokens[-1] if tokens else ""
                candidate = shorter[taken]

    def bytes_of_chunk(self, chunk: str) -> bytes:
        of = self.bytes_of.__getitem__
        if self.alphabet.issuperset(chunk):
            end = len(chunk)
            while end > 1 and chunk[end - 2 : end] not in self.adjacent:
                end -= 1
            if end == len(chunk):
                return b"".join(map(of, self.segment(chunk)))
            return self.chunk(chunk[:end]) + b"".join(map(of, chunk[end:]))
        found: list[bytes] = []
        start = 0
        for i, ch in enumerate(chunk):
            if ch not in self.id_of:
                if i > start:
                    found += map(of, self.segment(chunk[start:i]))
                found += [struct.pack("<I", self.byte_ids[b]) for b in ch.encode()]
                start = i + 1
        if start < len(chunk):
            found += map(of, self.segment(chunk[start:]))
        return b"".join(found)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        found = self._chunks.get(chunk)
        if found is None:
            if len(self._chunks) >= MEMO_ENTRIES:
                self._chunks.clear()
            found = self._chunks[chunk] = self.bytes_of_chunk(chunk)
        return found

    def body(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end, as 32-bit integers."""
        if not text:
            return b""
        get, make = self._chunks.get, self.chunk
        return b"".join([get(c) or make(c) for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))])

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text with begin and end ids."""
        return np.frombuffer(EDGES[:4] + self.body(text) + EDGES[4:], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids are silent, the dummy space mark is dropped."""
        data = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(vocabulary: Vocabulary) -> Codec:
    """The worker's codec; tables and memos outlive a batch."""
    key = hash(vocabulary.pieces[:50]) ^ len(vocabulary.pieces)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode_decode(
    docs: DataFrame, model_path: str | None = None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), emit_ids: bool = False
) -> DataFrame:
    """Encode every whole text exactly and decode it again.

    Adds ``n_tokens`` (with begin and end ids), ``ids_sha256``,
    ``decoded_sha256`` and, with ``emit_ids``, the ``ids`` themselves and the
    ``decoded`` text, to the columns named in ``keep``; other columns of the
    input are left out, so clashing names can't occur.

    Null and empty texts encode to the two control ids and decode to an empty
    text. Very long texts are handled whole. Rows are independent: repeated
    rows give repeated results and an empty table an empty one. One pass over
    the scan, no shuffle; the only broadcast is the vocabulary (about 1 MB,
    fixed by the model).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))
    source = docs.select(*keep, docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if emit_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            counts, id_digests, text_digests, all_ids, texts = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):  # one text at a time in memory
                ids = codec.encode(value.as_py() or "")
                decoded = codec.decode(ids)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if emit_ids:
                    all_ids.append(ids.astype("i4"))
                    texts.append(decoded)
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if emit_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)

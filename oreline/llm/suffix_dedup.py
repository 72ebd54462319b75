"""Exact removal of repeated byte strings with a distributed, sparse suffix array.

A full suffix array of a corpus is many times its size, so suffixes are kept
only at anchors. Every 400-byte window has a minimiser, the start of its least
hashed 8-gram among its first 200 positions; equal windows have it at equal
offsets, so two equal windows always meet at an anchor each.

1. *Leading tokens.* The suffixes at all anchors are range-partitioned and
   sorted by their leading token and a hash of their first 200 bytes. A suffix
   that shares neither with another one has no repeated window. A hash can only
   add candidates here, never lose one.
2. *Suffix array.* The candidates come back with their bytes: up to 400 from
   the anchor on and up to 199 before it. They are range-partitioned by three
   leading tokens (Spark samples the splitters) and sorted in each bucket by
   multikey quicksort on their bytes. A window is repeated inside the bucket if
   another suffix shares its right part (a run of the suffix array) and its left
   part (a run of the same suffixes sorted by the bytes before the anchor).
3. *Borders.* Suffixes that share the leading tokens of a bucket's first or
   last one may have partners in other buckets: their distinct windows are
   compared across buckets, by 128-bit BLAKE2 digests, as a Spark aggregate.

Rows are part of the partition key, so a string that a third of all documents
hold is cut over many buckets. Copies that one task sees are combined before
they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.storage import Passes

_GRAM = 8
#: Suffixes of one bucket, about: without and with their bytes.
BUCKET_ROWS, BUCKET_SUFFIXES = 400_000, 40_000
#: Digests that a task remembers to combine copies.
_MEMO = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGN = np.uint64(1 << 63)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as texts are long."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            ones = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([ones, np.full(size, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([ones, np.full(size, _UNBASE)]), dtype=np.uint64)


_POWERS = _Powers()


class Bytes:
    """Fingerprints of any stretch of one text in constant time."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)
        _POWERS.reach(self.n + 1)
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _POWERS.up[: self.n], dtype=np.uint64)])

    def prints(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * _POWERS.down[start]
        return (h ^ h >> np.uint64(31)).view(np.int64)

    def words(self) -> np.ndarray:
        """The eight bytes from every place on, as numbers that sort as they do."""
        return np.ndarray((max(0, self.n - _GRAM + 1),), ">u8", self.data, strides=(1,))

    def leading(self, start: np.ndarray) -> np.ndarray:
        return (self.words()[start].astype(np.uint64) ^ _SIGN).view(np.int64)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` neighbours, in linear time."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(text: Bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``place, first, last``: minimisers and the run of window starts of each."""
    reach = length // 2
    n_windows = text.n - length + 1
    grams = text.words().astype(np.uint64)[: text.n - reach]
    h = grams * _BASE
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(max(20, int(text.n).bit_length()))
    key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    place = (_sliding_least(key, reach)[:n_windows] & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], change])
    return place[first], first, np.concatenate([change - 1, [n_windows - 1]])


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: sort by the first, then only equal runs by the next."""
    order = np.argsort(tokens[0], kind="quicksort")
    tied = np.zeros(len(order), bool)
    equal = tokens[0][order][1:] == tokens[0][order][:-1]
    for depth in range(1, len(tokens)):
        run = np.concatenate([[0], np.cumsum(~equal)])
        tied[:] = False
        tied[1:] |= equal
        tied[:-1] |= equal
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((tokens[depth][rows], run[at]))]
        equal = equal & (tokens[depth][order][1:] == tokens[depth][order][:-1])
    return order


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _batch(ddl: str, columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


_LEAD = "token bigint, print bigint, doc bigint, part bigint, salt bigint, twice boolean"
_SEEN = "token bigint, print bigint, doc bigint, part bigint, found boolean, edge boolean"
_SUFFIX = "t0 bigint, t1 bigint, t2 bigint, print bigint, salt bigint, doc bigint, part bigint, place int, first int, last int, bytes binary, before binary"
_MARK = "doc bigint, part bigint, a int, b int, digest binary, alone boolean"
_WINDOWS = ", ".join(_MARK.split(", ")[:4])


_TOLD = "told_doc bigint, told_part bigint, a int, b int"


def _both(rows: list[tuple], told: list[tuple], ddl: str) -> pa.RecordBatch:
    """Suffix rows and rows of windows already known to be repeated, in one batch."""
    suffix, known = len(_SUFFIX.split(", ")), len(_TOLD.split(", "))
    return _batch(ddl, list(zip(*[(*r, *[None] * known) for r in rows], *[(*[None] * suffix, *t) for t in told])) or [()] * (suffix + known))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of one bucket that share token and hash, and one row of each key at its borders."""
    table = _whole(batches)
    if table is None:
        return
    c = {name: table[name].to_numpy() for name in table.schema.names}
    order = multikey_order([c["token"], c["print"]])
    c = {k: v[order] for k, v in c.items()}
    same = np.concatenate([[False], (c["token"][1:] == c["token"][:-1]) & (c["print"][1:] == c["print"][:-1]), [False]])
    found = same[:-1] | same[1:] | c["twice"].astype(bool)
    edge = np.zeros(len(order), bool)
    edge[[0, np.flatnonzero(~same[:-1])[-1]]] = True  # the first of the first and of the last key
    keep = found | edge
    yield _batch(_SEEN, [c[k][keep] for k in ("token", "print", "doc", "part")] + [found[keep], edge[keep]])


def _rows_of_bytes(values: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of a matrix, filled up with zeros."""
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def _tokens(matrix: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes as numbers that sort as the bytes do."""
    return list(np.ascontiguousarray(matrix).view(">u8").astype(np.uint64).T)


def _shared(matrix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common start of each row and the next one in an order."""
    out = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(out), 4096):
        rows = matrix[order[at : at + 4097]]
        differ = rows[1:] != rows[:-1]
        out[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return out


def _judge_bucket(c: dict, length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a bucket of suffixes, and what its borders must tell each other."""
    n, half = len(c["doc"]), length // 2
    right = _rows_of_bytes(c["bytes"], -(-length // 8) * 8)
    left = _rows_of_bytes([b[::-1] for b in c["before"]], -(-half // 8) * 8)
    place, least, most = c["place"], c["place"] - c["last"], c["place"] - c["first"]  # of a window's anchor in it
    order = multikey_order(_tokens(right))
    depth = _shared(right, order)
    group = np.empty(n, np.int64)
    group[order] = np.concatenate([[0], np.cumsum(depth < half)])
    left_order = multikey_order([group, *_tokens(left)])
    left_depth = np.where(np.diff(group[left_order]) == 0, _shared(left, left_order), -1)

    lead = [c[k] for k in ("t0", "t1", "t2", "print")]
    ranged = np.lexsort(lead[::-1])
    border = np.zeros(n, bool)
    for end in ranged[[0, -1]]:
        border |= np.logical_and.reduce([k == k[end] for k in lead])

    repeated = np.zeros((n, half + 1), bool)  # one column more than offsets, so that runs end inside
    told: list[tuple[int, np.ndarray, np.ndarray]] = []
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= most))
        # rows that hold a window at this offset have all of its bytes, so the filling never counts
        run_right[order] = np.concatenate([[0], np.cumsum(depth < length - offset)])
        run_left[left_order] = np.concatenate([[0], np.cumsum(left_depth < offset)])
        _, first, of, count = np.unique(run_right[rows] * (n + 1) + run_left[rows], return_index=True, return_inverse=True, return_counts=True)
        repeated[rows, offset] = count[of] > 1
        at_border = border[rows[first]]
        told.append((offset, rows[first][at_border], count[at_border] == 1))

    step = np.diff(np.concatenate([np.zeros((n, 1), np.int8), repeated.astype(np.int8)], axis=1), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1] - 1
    none = np.full(len(row), None)
    yield _batch(_MARK, [c["doc"][row], c["part"][row], place[row] - end, place[row] - start, none, none])
    for offset, r, alone in told:
        digests = [_digest(c["before"][i][len(c["before"][i]) - offset :] + c["bytes"][i][: length - offset]) for i in r.tolist()]
        yield _batch(_MARK, [c["doc"][r], c["part"][r], place[r] - offset, place[r] - offset, digests, alone])


def _ranges(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by ``[start, end)`` stretches."""
    out: list[list[int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def removed_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 400, emit_text: bool = False) -> DataFrame:
    """What is left of every whole text when repeated strings are removed.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes over it
    also starts anywhere else in the table, in the same text or another; all is
    judged on the input. Returns ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and, with ``emit_text``, ``kept`` (the remaining bytes).

    Null and empty texts have no bytes; texts shorter than ``length`` stay
    whole. Repeated rows repeat each other's strings. Ids may be null or occur
    twice: rows are told apart by 128 bits of hashes of id and text. An empty
    table gives an empty one; other columns are ignored. Texts are shuffled
    once, and those with a candidate once more; nothing is broadcast, and the
    driver sees two counts. Long texts are read whole, and in a text that
    repeats itself (a line of one sign, a table of zeros) each distinct suffix
    is sorted once.
    """
    if length < 8 * _GRAM:  # the leading tokens must lie in the half that equal windows share
        raise ValueError(f"length must be at least {8 * _GRAM}")
    spark = docs.sparkSession
    half = length // 2
    # two hashes of the text with different seeds, one of which the id gives: 128 bits between rows of one id
    key = [F.xxhash64(F.col(doc_id), F.col(text)).alias("doc"), F.xxhash64(F.lit("part"), F.col(text)).alias("part")]
    source = docs.select(*key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"), F.col(doc_id).cast("long").alias("doc_id"))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passes = Passes(spark, "suffix-dedup")

    def lead_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct token and hash of the suffixes of each text, and whether it has them twice."""
        salt, held, size = 0, [], 0
        for batch in batches:
            for doc, part, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(data) < length:
                    continue
                t = Bytes(data)
                place = anchors(t, length)[0]
                hashed = t.prints(place, half)
                _, first, count = np.unique(hashed, return_index=True, return_counts=True)
                k, salt = len(first), salt + 1
                held.append([t.leading(place[first]), hashed[first], np.full(k, doc), np.full(k, part), np.full(k, salt), count > 1])
                size += k
                if size > 200_000:
                    yield _batch(_LEAD, [np.concatenate(x) for x in zip(*held)])
                    held, size = [], 0
        if held:
            yield _batch(_LEAD, [np.concatenate(x) for x in zip(*held)])

    leads = passes.write(source.select("doc", "part", "data").where(F.length("data") >= length).mapInArrow(lead_rows, _LEAD), "leads")
    buckets = max(parallel, math.ceil(leads.count() / BUCKET_ROWS))
    seen = passes.write(leads.repartitionByRange(buckets, "token", "print", "doc", "part", "salt").mapInArrow(_candidates, _SEEN), "candidates")
    passes.drop("leads")
    across = seen.where("edge").groupBy("token", "print").agg(F.count("*").alias("n")).where("n > 1")
    candidates = seen.where("found").select("doc", "part", "print").union(seen.where("NOT found").join(across, ["token", "print"], "left_semi").select("doc", "part", "print"))
    by_text = candidates.groupBy("doc", "part").agg(F.collect_set("print").alias("prints"))

    n_bytes = F.length("data").cast("long").alias("n_bytes")
    kept = [F.when(F.col("prints").isNull(), F.sha2("data", 256)).alias("kept_sha256"), *([F.when(F.col("prints").isNull(), F.col("data")).alias("kept")] if emit_text else [])]
    texts = passes.write(
        source.join(by_text, ["doc", "part"], "left").select("doc_id", n_bytes, *kept, "doc", "part", "prints", F.when(F.col("prints").isNotNull(), F.col("data")).alias("data")),
        "texts",
    )
    passes.drop("candidates")
    pending = texts.where("prints IS NOT NULL")

    def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates with their bytes, once per task; what the task saw twice is told as well."""
        memo: dict[bytes, tuple | None] = {}
        salt, rows, told = 0, [], []
        ddl = f"{_SUFFIX}, {_TOLD}"
        for batch in batches:
            for doc, part, data, prints in zip(*(batch.column(i).to_pylist() for i in range(4))):
                t = Bytes(data)
                place, first, last = anchors(t, length)
                hashed = t.prints(place, half)
                at = np.flatnonzero(np.isin(hashed, prints))
                lead = [t.leading(place[at] + _GRAM * i).tolist() for i in range(3)]
                for i, (x, a, b, h, *tokens) in enumerate(zip(place[at].tolist(), first[at].tolist(), last[at].tolist(), hashed[at].tolist(), *lead)):
                    before, behind = data[a:x], data[x : b + length]
                    name = _digest(before + behind + (x - a).to_bytes(4, "big"))
                    if name in memo:
                        if memo[name]:
                            told.append(memo[name])
                            memo[name] = None
                        told.append((doc, part, a, b))
                        continue
                    memo[name] = (doc, part, a, b)
                    rows.append((*tokens, h, salt, doc, part, x, a, b, behind, before))
                    salt += 1
                if len(memo) > _MEMO:
                    memo.clear()
                if len(rows) + len(told) > 5000:
                    yield _both(rows, told, ddl)
                    rows, told = [], []
        yield _both(rows, told, ddl)

    suffixes = passes.write(pending.select("doc", "part", "data", "prints").mapInArrow(suffix_rows, f"{_SUFFIX}, {_TOLD}"), "suffixes")
    own = suffixes.where("bytes IS NULL").select(F.col("told_doc").alias("doc"), F.col("told_part").alias("part"), "a", "b")
    sorted_rows = suffixes.where("bytes IS NOT NULL").select(*(f.split()[0] for f in _SUFFIX.split(", ")))
    buckets = max(parallel, math.ceil(sorted_rows.count() / BUCKET_SUFFIXES))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            yield from _judge_bucket({n: table[n].to_pylist() if n in ("bytes", "before") else table[n].to_numpy() for n in table.schema.names}, length)

    ranged = sorted_rows.repartitionByRange(buckets, "t0", "t1", "t2", "print", "doc", "part", "place", "salt")
    marks = passes.write(ranged.mapInArrow(judge, _MARK), "marks")
    shared = marks.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    border = marks.where("alone").join(shared, "digest", "left_semi").select("doc", "part", "a", "b")
    windows = own.union(marks.where("digest IS NULL").select("doc", "part", "a", "b")).union(border)
    stretches = windows.groupBy("doc", "part").agg(F.collect_set(F.struct("a", "b")).alias("windows"))

    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if emit_text else "")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cut = _ranges([(w["a"], w["b"] + length) for w in found or []])
                left = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)]))
                rows.append((doc, len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left)[: 5 + emit_text])
            yield _batch(result, list(zip(*rows)) or [()] * (5 + emit_text))

    zero = F.lit(0).cast("long")
    closed = texts.where("prints IS NULL").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", *(["kept"] if emit_text else []))
    return closed.union(pending.join(stretches, ["doc", "part"], "left").select("doc_id", "data", "windows").mapInArrow(close, result))

"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a product code on the 64 fingerprint bits: the
perfect binary Golay code (23 bits, covering radius 3) on each of two blocks
and a single word on the 18 bits left. Every fingerprint has one home anchor,
its nearest word. If two fingerprints differ in at most t bits, the second lies
within the covering radius plus t of the first one's home, so it is enough to
replicate each fingerprint to the anchors at most that far away and to compare,
at each anchor, the fingerprints at home there with the replicas. Of those
anchors only the ones that are home to some word within t bits of the
fingerprint can matter; the tables below hold exactly these (about 76 of 2^24
at t = 2).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.rows import column, packed, schema_with, unpacked
from oreline.operators.graph import connected_components
from oreline.storage import written

BLOCK_BITS = 23
BLOCK_MASK = (1 << BLOCK_BITS) - 1
_GENERATOR = 0b101011100011  # of the Golay code, degree 11


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit majority fingerprint of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]
    values = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, "<u8").view("<i8"))], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text]).mapInArrow(run, "doc_id bigint, fp bigint")


def _remainder(word: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder after division by the generator."""
    word = word.copy()
    for bit in range(BLOCK_BITS - 1, 10, -1):
        word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0)
    return word


@lru_cache(maxsize=4)
def covering_tables(threshold: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Coset leaders by syndrome, and reachable anchor changes by syndrome and flips.

    The second table's entry ``[s][k]`` holds the differences between the home
    of a word with syndrome ``s`` and the homes that take exactly ``k`` flipped
    bits at least, for ``k`` from 0 (no change) to the threshold.
    """
    by_weight = [np.array([sum(1 << b for b in bits) for bits in combinations(range(BLOCK_BITS), k)], np.int64) for k in range(max(3, threshold) + 1)]
    light = np.concatenate(by_weight[:4])
    leader = np.zeros(1 << 11, np.int64)
    leader[_remainder(light)] = light  # perfect: each syndrome exactly once
    changes = []
    flips = [(k, e, s) for k in range(threshold + 1) for e, s in zip(by_weight[k], _remainder(by_weight[k]))]
    weight = np.array([k for k, _, _ in flips])
    errors = np.array([e for _, e, _ in flips])
    syndromes = np.array([s for _, _, s in flips])
    for s in range(1 << 11):
        delta = errors ^ leader[s ^ syndromes] ^ leader[s]
        kept, first = np.unique(delta, return_index=True)  # flips come lightest first
        changes.append([kept[weight[first] == k] for k in range(threshold + 1)])
    return leader, changes


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor of each fingerprint and all anchors it is replicated to."""
    leader, changes = covering_tables(threshold)
    low, high = fp & BLOCK_MASK, fp >> BLOCK_BITS & BLOCK_MASK
    s_low, s_high = _remainder(low), _remainder(high)
    home = (low ^ leader[s_low]) | (high ^ leader[s_high]) << BLOCK_BITS
    replicas = []
    for at, a, b in zip(home, s_low, s_high):
        parts = [
            (at ^ changes[a][i][:, None] ^ changes[b][j][None, :] << BLOCK_BITS).ravel()
            for i in range(threshold + 1)
            for j in range(threshold + 1 - i)
        ]
        replicas.append(np.concatenate(parts))
    return home, replicas


def linked_pairs(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at most ``threshold`` bits apart.

    ``fps`` has one row per distinct fingerprint, in a column ``fp``. Both sides
    are shuffled by anchor at any size: Spark estimates the replicas at little
    more than ``fps``, whose rows they outnumber 76 times, and would broadcast them.
    """

    def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(fp, 0)[0]), batch.column(0)], ["anchor", "a"])

    def replica_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                replicas = anchors(part, threshold)[1]
                b = np.repeat(part, [len(r) for r in replicas])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(replicas)), pa.array(b)], ["anchor", "b"])

    one = fps.select("fp")
    home = one.mapInArrow(home_rows, "anchor bigint, a bigint")
    near = one.mapInArrow(replica_rows, "anchor bigint, b bigint")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return home.join(near.hint("merge"), (home["anchor"] == near["anchor"]) & (F.col("a") < F.col("b")) & close).select("a", "b")


def _labelled(prints: DataFrame, threshold: int) -> DataFrame:
    """``fp, first_id, component`` of the distinct fingerprints of ``doc_id, fp``."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    groups = connected_components(linked_pairs(distinct, threshold), "a", "b")
    return distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns ``doc_id, fp, component_id``: the component is the smallest doc_id
    reachable through fingerprints that differ in at most ``threshold`` bits.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other; texts shorter than a shingle hash as one piece. Copies meet as one
    distinct fingerprint before anything is compared, so a group of copies
    costs one row however large it is. Repeated rows stay; an empty table gives
    an empty result; other columns are ignored. A row without a doc_id keeps
    its fingerprint and takes its group's smallest id.
    """
    prints = written(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle), "fingerprints")
    labelled = _labelled(prints, threshold)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Between rows of that id and fingerprint the one with the smallest text hash
    stays. A group without any id keeps one row. Columns stay as they are,
    whatever their names. Rows are written once, with their fingerprint.
    """
    source = packed(docs, id=column(doc_id).cast("long"), by_text=F.xxhash64(column(text)), text=column(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), shingle) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(fps, "<u8").view("<i8"))], ["row", "id", "by_text", "fp"])

    rows = written(source.mapInArrow(run, schema_with(source.drop("text"), "fp bigint")), "rows-with-fingerprints")
    first = F.struct(F.col("first_id").isNull(), "first_id", "fp")
    labelled = _labelled(rows.select(F.col("id").alias("doc_id"), "fp"), threshold)
    stay = labelled.groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.first_id").alias("stays"), F.col("first.fp").alias("stays_fp"))
    chosen = rows.join(stay, (F.col("fp") == F.col("stays_fp")) & F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    place = F.row_number().over(Window.partitionBy("fp", "id").orderBy("by_text", F.xxhash64("row")))
    return unpacked(chosen.withColumn("place", place).where("place = 1"))


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

"""Prefix trie of conversations, as the Cartesian tree of their sorted order.

Distinct sequences of turns are sorted; the common prefix of neighbours is an
array over the sorted order, and its Cartesian tree, with equal nodes merged, is
the trie without its unary paths. Every boundary between neighbours finds the
nearest boundaries with a shorter common prefix on both sides; boundaries that
find the same two are one node, and the sequences between those two are its
subtree. Depths on the way down to a node, or to the end of a sequence, that no
boundary has are filled in last, from the sequence at the left end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm.ordering import numbered
from oreline.llm.rows import column
from oreline.llm.smaller_values import BLOCK, nearest_smaller, stretch_totals
from oreline.storage import Passes

#: Most turns that a conversation takes from the one its id is rounded down to.
SHARED_TURNS = 8
_IDS_AT_ONCE = 1 << 15
CHILDREN_AT_ONCE = 64
_NO_TURNS = "array<struct<token:binary,bytes:int>>"


def rebuilt(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns`` of every conversation, with the start it shares with its neighbours.

    A turn is a 128-bit digest of role and text, and the text's bytes. Turns
    go by ``turn`` (null first), then by their digest; null role and text are
    empty; rows without a conv_id belong to no conversation. Conversation c
    starts with the first h turns of c - c % 5, where h is the crc32 of its
    decimal id modulo 9, and goes on with its own turns after its first h.
    """
    who, what = F.coalesce(column(role).cast("string"), F.lit("")), F.coalesce(column(text), F.lit(""))
    token = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256), 1, 32))
    each = turns.select(column(conv_id).cast("long").alias("conv_id"), F.struct(column(turn).alias("turn"), token.alias("token"), F.octet_length(what).alias("bytes")).alias("t"))
    lists = each.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = lists.select("conv_id", F.transform("t", lambda t: F.struct(t["token"].alias("token"), t["bytes"].alias("bytes"))).alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED_TURNS).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_TURNS + 1)).cast("int")
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(base, "base", "left").withColumn("h", taken)
    head = F.slice(F.coalesce("head", F.array().cast(_NO_TURNS)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


def member_digests(members: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of each key's conv_ids, ascending, joined by commas.

    Ids are dealt by range of (key, id) and joined into pieces of 32,768 there;
    a key's pieces then pass through one task, which hashes them one by one.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "low", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == _IDS_AT_ONCE):
                    yield out()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "ends"])
            done = []
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "ends"])

    dealt = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = dealt.mapInArrow(pieces, "key string, low bigint, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "low").mapInArrow(digests, "key string, ends string")


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two different sequences."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x["token"] == y["token"], F.lit(False))), F.lit(False))
    return differs.cast("long") - 1


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bytes_before(bytes_: pd.Series) -> pd.Series:
    """For each depth from 0: the bytes of all turns before the node's last."""
    return bytes_.map(lambda b: np.concatenate([[0, 0], np.cumsum(np.asarray(b, np.int64))])[: len(b) + 1])


def _sequences(convs: DataFrame, passes: Passes) -> DataFrame:
    """The distinct sequences in their order, each with its common prefix with the one before and behind.

    Columns: ``pos``, ``lcp`` (-1 for the first), ``next_lcp`` (-1 for the last),
    ``len``, ``ends``, ``before`` and, for totals: ``n`` conversations, the least
    of them, ``leaves``, ``weighted`` bytes (every conversation's) and ``fresh``
    ones (behind ``lcp``).
    """
    key = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["token"])), "").cast("binary"), 256)
    keyed = passes.write(convs.withColumn("key", key), "rebuilt")
    distinct = keyed.groupBy("key").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    whole = passes.write(distinct.join(member_digests(keyed), "key").drop("key"), "distinct")
    lined = numbered(whole, ["turns"], passes, "sorted", place="pos")
    # A block's window also holds the sequence before and the one behind the block.
    own = F.expr(f"pos div {BLOCK}")
    near = F.array_distinct(F.array(own, F.expr(f"(pos + 1) div {BLOCK}"), F.expr(f"greatest(pos - 1, 0) div {BLOCK}")))
    window = Window.partitionBy("block").orderBy("pos")
    seen = lined.withColumn("block", F.explode(near)).withColumn("previous", F.lag("turns").over(window)).withColumn("following", F.lead("turns").over(window)).where(own == F.col("block"))
    total = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda acc, t: acc + t["bytes"])
    compared = seen.select(
        "pos", "turns", "n", "least", "ends",
        F.when(F.col("pos") == 0, F.lit(-1).cast("long")).otherwise(_common(F.col("previous"), F.col("turns"))).alias("lcp"),
        F.when(F.col("following").isNull(), F.lit(-1).cast("long")).otherwise(_common(F.col("turns"), F.col("following"))).alias("next_lcp"),
        F.size("turns").cast("long").alias("len"),
        total(F.col("turns")).alias("total"),
    )
    shared = total(F.slice("turns", F.lit(1), F.greatest("lcp", F.lit(0)).cast("int")))
    measured = compared.select(
        "pos", "lcp", "next_lcp", "len", "n", "least", "ends",
        (F.col("next_lcp") < F.col("len")).cast("long").alias("leaves"),
        (F.col("n") * F.col("total")).alias("weighted"),
        (F.col("total") - shared).alias("fresh"),
        shared.alias("shared"),
        _bytes_before(F.transform("turns", lambda t: t["bytes"])).alias("before"),
    )
    return passes.write(measured, "sequences")


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of ``conv_id, turns``, one row each.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``
    (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that members share, over the subtree) and
    ``ends_sha256`` (of the members that end at the node).

    Copies of a sequence are one from the start, with their count and digest.
    No conversations give no nodes, not even the root; a conversation without
    turns is a member of the root. One conversation's digests, 20 bytes a turn,
    are one row; its texts are not.
    """
    passes = Passes(convs.sparkSession, "trie")
    sequences = _sequences(convs, passes)
    several = sequences.count()
    boundaries = passes.write(nearest_smaller(sequences.select(F.col("pos").alias("at"), "pos", F.col("lcp").alias("value"), F.lit(0).cast("long").alias("owner")), passes), "boundaries")
    inner = boundaries.where("pos > 0").groupBy("left", F.coalesce("right", F.lit(several).cast("long")).alias("right"), "value").agg(F.count("*").alias("equal"))
    sums = ["n", "leaves", "weighted", "fresh"]
    totals = stretch_totals(sequences.select("pos", *sums, "least"), inner.select(F.col("left").alias("lo"), F.col("right").alias("hi")), sums, "least", passes)
    nodes = passes.write(inner.withColumnsRenamed({"left": "lo", "right": "hi"}).join(totals, ["lo", "hi"]), "nodes")

    first = sequences.join(boundaries.select("pos", "left"), "pos").select(F.col("pos").alias("lo"), "lcp", "next_lcp", "len", "ends", "shared", "before", "left", *(F.col(c).alias(f"own_{c}") for c in (*sums, "least")))
    behind = sequences.select(F.col("pos").alias("hi"), F.col("lcp").alias("hi_lcp"))
    outer = F.coalesce("hi_lcp", F.lit(-1))
    branching = nodes.join(behind, "hi", "left").join(first, "lo").select(
        "lo", "len", "ends", "shared", "before", *sums, "least", F.col("value").alias("depth"),
        F.greatest("lcp", outer).alias("above"),
        F.when(outer > F.col("lcp"), F.col("lo")).otherwise(F.col("left")).alias("above_lo"),
        (F.col("equal") + 1 - (F.col("len") == F.col("value")).cast("int")).alias("children"),
    )
    ending = first.select(
        "lo", "len", "ends", "shared", "before", *(F.col(f"own_{c}").alias(c) for c in (*sums, "least")), F.col("len").alias("depth"),
        F.greatest("lcp", "next_lcp").alias("above"),
        F.when(F.col("next_lcp") > F.col("lcp"), F.col("lo")).otherwise(F.col("left")).alias("above_lo"),
        F.lit(0).cast("long").alias("children"),
    ).where("depth > above")
    paths = branching.union(ending).withColumn("block", F.expr(f"lo div {CHILDREN_AT_ONCE}"))
    # A node's least member comes to its children by short stretches, never to all of them at once.
    asked = paths.select("block", "above_lo", "above").distinct()
    parents = asked.join(nodes.select(F.col("lo").alias("above_lo"), F.col("value").alias("above"), F.col("least").alias("above_least")), ["above_lo", "above"])
    known = paths.join(parents, ["block", "above_lo", "above"], "left")
    depths = F.sequence(F.col("above") + 1, F.col("depth"))
    steps = F.arrays_zip(depths.alias("depth"), F.slice("before", (F.col("above") + 2).cast("int"), (F.col("depth") - F.col("above")).cast("int")).alias("before"))
    filled = known.select("len", "ends", "shared", *sums, "least", "above", "above_least", "children", F.col("depth").alias("bottom"), F.explode(steps).alias("step"))
    depth = F.col("step.depth")
    return filled.select(
        F.col("least").alias("conv_id"),
        depth.alias("depth"),
        F.when(depth == 0, None).when(depth == F.col("above") + 1, F.col("above_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(depth < F.col("bottom"), F.lit(1).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("fresh") - F.col("shared") - (F.col("n") - 1) * F.col("step.before")).alias("saved_tokens"),
        F.when(depth == F.col("len"), F.col("ends")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

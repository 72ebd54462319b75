"""Nearest smaller values of a long sequence, and totals over its stretches, by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.ordering import numbered
from oreline.storage import Passes

BLOCK = 4096


def scan(values: list[int]) -> tuple[list[int | None], list[int | None], list[bool]]:
    """Nearest smaller values to the left and right within one block, and the block's minima.

    The minima are the values that stay open to a side: of each that is open to
    the left the first, of each that is open to the right the last. Nothing
    outside the block can have any other of its values as its answer.
    """
    left: list[int | None] = [None] * len(values)
    right: list[int | None] = [None] * len(values)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1] if values[stack[-1]] < v else left[stack[-1]]
        stack.append(i)
    minima = [False] * len(values)
    lowest = None
    for i, v in enumerate(values):
        if left[i] is None and v != lowest:
            minima[i], lowest = True, v
    lowest = None
    for i in reversed(stack):
        if values[i] != lowest:
            minima[i], lowest = True, values[i]
    return left, right, minima


def nearest_smaller(items: DataFrame, passes: Passes, level: int = 0) -> DataFrame:
    """``owner, pos, value, left, right``: where the nearest strictly smaller values stand, null if nowhere.

    ``items`` has ``at`` (0 to n - 1), ``pos`` (ascending with ``at``), ``value``
    and ``owner``, which is handed through. Each block of 4,096 is scanned with a
    stack; what stays open is settled by the same search over all blocks'
    minima, which are as many at most as a block has distinct values, twice.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        pos = table["pos"].to_pylist()
        left, right, minima = scan(table["value"].to_pylist())
        place = lambda found: pa.array([None if i is None else pos[i] for i in found], pa.int64())
        return table.drop_columns("at").append_column("left", place(left)).append_column("right", place(right)).append_column("minimum", pa.array(minima))

    blocks = items.select("at", "pos", "value", "owner", F.expr(f"at div {BLOCK}").alias("block"))
    scanned = passes.write(blocks.groupBy("block").applyInArrow(run, "pos bigint, value bigint, owner bigint, block bigint, left bigint, right bigint, minimum boolean"), f"scanned-{level}")
    if not scanned.where("block > 0").limit(1).count():
        return scanned.select("owner", "pos", "value", "left", "right")
    minima = scanned.where("minimum").select("pos", "value", F.col("block").alias("owner"))
    above = nearest_smaller(numbered(minima, ["pos"], passes, f"minima-{level}"), passes, level + 1)
    answers = above.groupBy("owner", "value").agg(F.min_by("left", "pos").alias("far_left"), F.max_by("right", "pos").alias("far_right")).withColumnRenamed("owner", "block")
    closed = scanned.where("left IS NOT NULL AND right IS NOT NULL").select("owner", "pos", "value", "left", "right")
    still = scanned.where("left IS NULL OR right IS NULL").join(answers, ["block", "value"])
    return closed.union(still.select("owner", "pos", "value", F.coalesce("left", "far_left"), F.coalesce("right", "far_right")))


def stretch_totals(items: DataFrame, stretches: DataFrame, sums: list[str], least: str, passes: Passes, level: int = 0) -> DataFrame:
    """Sums and the least value over each stretch ``lo <= pos < hi``.

    ``items`` has ``pos`` (0 to n - 1), the columns ``sums`` and ``least``;
    ``stretches`` distinct ``lo, hi``, none empty. A stretch is answered in the
    blocks of its two ends; whole blocks between them by the same search over
    the blocks' totals.
    """
    columns = [*sums, least]
    first, last = F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}")
    part = lambda block, a, b: F.struct(block.alias("block"), a.alias("a"), b.alias("b"))
    ends = F.when(first == last, F.array(part(first, F.col("lo"), F.col("hi")))).otherwise(F.array(part(first, F.col("lo"), (first + 1) * BLOCK), part(last, last * BLOCK, F.col("hi"))))
    parts = stretches.select("lo", "hi", F.explode(ends).alias("part")).select("lo", "hi", "part.*")
    blocks = items.select("pos", *columns, F.expr(f"pos div {BLOCK}").alias("block"))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        zero = own["pos"][0].as_py() if own.num_rows else 0
        a, b = (asked[c].to_numpy() - zero for c in ("a", "b"))
        out = {"lo": asked["lo"], "hi": asked["hi"]}
        for c in sums:
            running = np.concatenate([[0], np.cumsum(own[c].to_numpy())])
            out[c] = pa.array(running[b] - running[a], pa.int64())
        values = own[least].to_numpy()
        out[least] = pa.array([values[i:j].min() for i, j in zip(a.tolist(), b.tolist())], pa.int64())
        return pa.table(out)

    schema = ", ".join(f"{c} bigint" for c in ("lo", "hi", *columns))
    found = blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(run, schema)
    wide = stretches.select("lo", "hi", (first + 1).alias("from"), last.alias("to")).where("from < to")
    if wide.limit(1).count():
        totals = passes.write(blocks.groupBy("block").agg(*(F.sum(c).alias(c) for c in sums), F.min(least).alias(least)).withColumnRenamed("block", "pos"), f"block-totals-{level}")
        inner = stretch_totals(totals, wide.select(F.col("from").alias("lo"), F.col("to").alias("hi")).distinct(), sums, least, passes, level + 1)
        between = wide.join(inner.select(F.col("lo").alias("from"), F.col("hi").alias("to"), *columns), ["from", "to"])
        found = found.union(between.select("lo", "hi", *columns))
    return found.groupBy("lo", "hi").agg(*(F.sum(c).alias(c) for c in sums), F.min(least).alias(least))

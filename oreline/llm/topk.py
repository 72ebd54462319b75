"""Exact top-k inner-product search: tiled matrix products and tree-merged lists.

Queries form tiles and candidates form shards, both by a hash of the id, so a
task holds one tile and one shard whatever the table's size. Each (tile, shard)
pair meets through an equi-join key, is multiplied block by block, and keeps k
candidates per query (partial selection). The short lists then merge level by
level, a fixed number of lists at a time.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.storage import written

#: Rows of a query tile and of a candidate shard, on average.
TILE_ROWS, SHARD_ROWS = 16_384, 4096
#: Queries multiplied at once: bounds the score block to 512 x a shard.
BLOCK_ROWS = 512
#: Lists merged into one per level.
MERGE_FAN_IN = 64
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, x as double.

    A product beyond the range of a double counts as its largest number. Rows whose id or vector is null, or that hold a null or non-finite
    component, take no part.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    largest = F.lit(sys.float_info.max)

    def whole(c: Column) -> Column:
        y = F.least(largest, F.greatest(-largest, c * F.lit(float(scale))))
        return F.when(F.abs(y) >= _EXACT, y).otherwise(F.floor(y).cast("double"))  # doubles that large are whole

    return usable.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def block_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of two blocks of whole numbers held as doubles.

    Double products are exact while every partial sum stays below 2^53; larger
    vectors are multiplied as Python integers. Scores outside 64 bits become the
    largest or smallest 64-bit number, and rank and tie as such.
    """
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), np.int64)
    with np.errstate(over="ignore"):
        largest = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if largest < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in c]
    bounds = np.iinfo(np.int64)
    return np.array([[min(bounds.max, max(bounds.min + 1, sum(map(int.__mul__, a, b)))) for b in whole[1]] for a in whole[0]], dtype=np.int64)


def select_block(q_ids: np.ndarray, scores: np.ndarray, c_ids: np.ndarray, k: int) -> pd.DataFrame:
    """Best k candidates of each row; ``c_ids`` ascend, ties go to the smaller id."""
    own = q_ids[:, None] == c_ids[None, :]
    allowed = ~own
    low = np.iinfo(np.int64).min
    masked = np.where(own, low, scores)
    if masked.shape[1] > k:
        edge = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed &= masked >= edge[:, None]
    row, col = np.nonzero(allowed)
    found = pd.DataFrame({"query_id": q_ids[row], "vec_id": c_ids[col], "score": scores[row, col], "__row": row})
    found = found.sort_values(["__row", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("__row").cumcount() < k].drop(columns="__row")


def _compared(tile: pd.DataFrame, shard: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    shard = shard.sort_values("vec_id", kind="stable")
    c_ids = shard["vec_id"].to_numpy()
    lengths = shard["v"].map(len).to_numpy()
    for length in np.unique(lengths):  # vectors of another length have no product
        same = tile[tile["v"].map(len) == length]
        if same.empty:
            continue
        c = np.stack(shard["v"].to_numpy()[lengths == length]) if length else np.zeros(((lengths == 0).sum(), 0))
        ids = c_ids[lengths == length]
        for at in range(0, len(same), BLOCK_ROWS):
            part = same.iloc[at : at + BLOCK_ROWS]
            q = np.stack(part["v"].to_numpy()) if length else np.zeros((len(part), 0))
            yield select_block(part["vec_id"].to_numpy(), block_scores(q, c), ids, k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k largest inner products of every query with all other vectors.

    Both inputs are ``vec_id, v`` as ``quantised`` gives them. Returns
    ``query_id, rank, vec_id, score``; all candidates where there are fewer
    than k. Ties go to the smaller vec_id; scores stay within 64 bits (see ``block_scores``). Candidates with the query's own id
    are left out; a repeated candidate row is a candidate of its own and a
    query id that occurs twice is answered once, for the least of its vectors. Vectors are compared with
    vectors of the same length only. Empty tables give an empty result.
    """
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n_tiles = max(1, math.ceil(asked.count() / TILE_ROWS))
    n_shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    tile_of = F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int")
    shard_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards)).cast("int")
    tiles = asked.select("vec_id", "v", tile_of.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    shards = vectors.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("tile"), shard_of.alias("shard"))

    def compare(key: tuple, tile: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        parts = list(_compared(tile, shard, k)) if len(tile) and len(shard) else []
        found = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return found.assign(lists=key[1]).astype("int64")

    lists = tiles.groupBy("tile", "shard").cogroup(shards.groupBy("tile", "shard")).applyInPandas(compare, "query_id bigint, vec_id bigint, score bigint, lists bigint")
    n_lists = n_shards
    while True:
        n_lists = math.ceil(n_lists / MERGE_FAN_IN)
        group = F.floor(F.col("lists") / MERGE_FAN_IN).cast("long")
        best_first = Window.partitionBy("query_id", "lists").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("lists", group).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        if n_lists == 1:
            return lists.select("query_id", "rank", "vec_id", "score")

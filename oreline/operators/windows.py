"""Sequences: islands, k-th events, complete prefixes, range frames, thinning."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalar import month_number


def islands(df: DataFrame, keys: list[str], at: str, gap_seconds: int, tiebreak: str) -> DataFrame:
    """Number the runs of events that follow each other within a gap."""
    w = Window.partitionBy(*keys).orderBy(at, tiebreak)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    starts = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    return df.withColumn("__starts", starts).withColumn("island", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def kth_events(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Sequence numbers of the first ``most`` events of each key."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= most)


def complete_prefix(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Running sum through index m where all of 1..m are present; null after a hole."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    dense = F.count(value).over(w) == F.col(index)
    return df.withColumn("cumulative", F.when(dense, F.sum(value).over(w)))


def trailing_count(df: DataFrame, keys: list[str], month: str, months: int) -> DataFrame:
    """Other rows of the key within the trailing months, the row's own month included."""
    numbered = df.withColumn("__m", month_number(month))
    per_month = numbered.groupBy(*keys, "__m").agg(F.count("*").alias("__n"))  # the frame runs over months, not rows
    w = Window.partitionBy(*keys).orderBy("__m").rangeBetween(-months, 0)
    counts = per_month.withColumn("trailing", F.sum("__n").over(w) - 1).drop("__n")
    return joined_back(numbered, counts, [*keys, "__m"]).drop("__m")


def percent_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Share of each small count row in the total (one row joined, no global window)."""
    whole = counts.agg(F.sum(n).alias("__all"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("percent", 100.0 * F.col(n) / F.col("__all")).drop("__all")


def joined_back(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their key's row; null keys meet. Spark splits or broadcasts hot keys."""
    right = per_key.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(right, same, "left").drop(*(f"__key_{k}" for k in keys))


def overlap_count(df: DataFrame, keys: list[str], name: str = "overlaps") -> DataFrame:
    """Rows with the number of rows of their key, counted before they meet."""
    return joined_back(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def thinned(df: DataFrame, x: str, y: str, cell: float, key: str) -> DataFrame:
    """One row per grid cell, the one with the least hash of its key."""
    cx, cy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    w = Window.partitionBy("cell_x", "cell_y").orderBy(F.md5(F.col(key).cast("string").cast("binary")))
    return df.withColumns({"cell_x": cx, "cell_y": cy}).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def station_path(df: DataFrame, keys: list[str], depth: str, x: str, y: str, tiebreak: str, least: int = 2) -> DataFrame:
    """Ordered stations as a line text; rows without a depth are left out, short paths too."""
    ordered = df.where(F.col(depth).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(depth, tiebreak, x, y))).alias("s"))
    points = F.transform("s", lambda p: F.concat_ws(" ", p[x].cast("string"), p[y].cast("string")))
    return ordered.where(F.size("s") >= least).select(*keys, F.size("s").alias("n_stations"), F.concat(F.lit("LINESTRING("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


def survivors(df: DataFrame, keys: list[str], preference: list[tuple[str, bool]], value_order: str) -> tuple[DataFrame, DataFrame]:
    """Survivor of each identity by a registered preference order, and the losers."""
    order: list[Column] = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in preference]
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, value_order)))
    return ranked.where("__r = 1").drop("__r"), ranked.where("__r > 1").drop("__r").withColumn("reason_code", F.lit("identity_loser"))


def capped_history(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The newest ``cap`` rows of each key with the number of rows left out."""
    w = Window.partitionBy(*keys)
    marked = df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    return marked.where(F.col("place") <= cap).withColumn("older", F.greatest(F.col("__n") - cap, F.lit(0))).drop("__n")

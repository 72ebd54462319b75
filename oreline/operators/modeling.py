"""Model frames: cumulative labels, temporal splits, peer ladders and curves."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalar import WITHHELD, half_year, month_number
from oreline.operators.aggregates import continuous_percentiles

HORIZONS = (12, 24)


def cumulative_labels(rows: DataFrame, key: str, month: str, streams: list[str], fact: str, *, horizons: tuple[int, ...] = HORIZONS, slack: int = 4, withheld_keys: DataFrame | None = None) -> DataFrame:
    """Cumulative volume of the first k producing months, with a status per label.

    ``rows`` has one row per key and month with a column per stream (null where
    not filed) and a null-fact column. A month produces if any stream is above
    zero. Statuses by precedence: no_production, withheld, incomplete,
    intermittent, missing_stream_observation, complete; only the last has a
    value. A key listed in ``withheld_keys`` is withheld throughout.
    """
    producing = reduce(operator.or_, [F.coalesce(F.col(s) > 0, F.lit(False)) for s in streams])
    w = Window.partitionBy(key)
    counted = rows.withColumn("__p", producing)
    counted = counted.withColumn("__k", F.when(F.col("__p"), F.sum(F.col("__p").cast("int")).over(w.orderBy(month).rowsBetween(Window.unboundedPreceding, 0))))
    counted = counted.withColumn("__first", F.min(F.when(F.col("__p"), month_number(month))).over(w))
    frames = []
    for h in horizons:
        inside = F.col("__k") <= h
        last = F.max(F.when(F.col("__k") == h, month_number(month)))
        aggs = [F.count_if(inside).alias("n"), F.min("__first").alias("first"), last.alias("last"), F.count_if(F.col(fact) == WITHHELD).alias("hidden")]
        aggs += [F.sum(F.when(inside, F.col(s))).alias(f"v_{s}") for s in streams] + [F.count(F.when(inside, F.col(s))).alias(f"c_{s}") for s in streams]
        one = counted.groupBy(key).agg(*aggs)
        pairs = ", ".join(f"'{s}', v_{s}, c_{s}" for s in streams)
        frames.append(one.select(key, F.lit(h).alias("horizon"), "n", "first", "last", "hidden", F.expr(f"stack({len(streams)}, {pairs}) AS (stream, value, seen)")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    hidden = F.col("hidden") > 0
    if withheld_keys is not None:
        marked = withheld_keys.select(key).distinct().withColumn("__withheld", F.lit(True))
        out = out.join(marked, key, "left")
        hidden = hidden | F.coalesce("__withheld", F.lit(False))
    status = (
        F.when(F.col("n") == 0, "no_production").when(hidden, "withheld").when(F.col("n") < F.col("horizon"), "incomplete")
        .when(F.col("last") - F.col("first") + 1 > F.col("horizon") + slack, "intermittent")
        .when(F.col("seen") < F.col("horizon"), "missing_stream_observation").otherwise("complete")
    )
    return out.select(key, "horizon", "stream", status.alias("status"), F.when(status == "complete", F.col("value")).alias("value"))


def median_days(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``keys, median_day, n``: median date per key; between two days the earlier whole day."""
    epoch = F.lit("1970-01-01").cast("date")
    ordinals = df.select(*keys, F.datediff(day, epoch).alias("__day"))
    middle = continuous_percentiles(ordinals, keys, "__day", {"__middle": 0.5})
    return middle.select(*keys, F.date_add(epoch, F.floor("__middle").cast("int")).alias("median_day"), "n")


def temporal_split(df: DataFrame, key: str, group: str, day: str, boundary: Column, *, calibration_months: int = 12, most_share: float | None = 0.02) -> DataFrame:
    """train / calibration / test by the median day of each group; groups stay whole.

    A group that holds more than ``most_share`` of the keys is refused.
    """
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    groups = sizes.join(median_days(df, [group], day), F.col("__group").eqNullSafe(F.col(group)), "left").drop(group, "n").withColumnRenamed("__group", group)
    if most_share is not None:
        top = groups.agg(F.max("__n").alias("top"), F.sum("__n").alias("all")).first()
        if top["all"] and top["top"] > most_share * top["all"]:
            raise ValueError(f"one group holds {top['top']} of {top['all']} keys")
    start = F.add_months(boundary, -calibration_months)
    part = F.when(F.col("median_day") >= boundary, "test").when(F.col("median_day") >= start, "calibration").otherwise("train")
    return df.join(groups.select(group, "median_day", part.alias("split")), group).select(key, group, "median_day", "split")


def fallback_group(unit: str, day: str) -> Column:
    """Group of what has no place: its unit and half-year."""
    return F.concat_ws("|", unit, half_year(day))


def ladder(subjects: DataFrame, peers: DataFrame, rungs: list[list[str]], key: str, own: str, *, floor: int = 20) -> DataFrame:
    """First rung whose peer count, own group left out, meets the floor; else unavailable.

    Peers are counted once per rung key and once per rung key and group, so the
    join grows with the subjects, not with subjects times peers.
    """
    out = subjects
    chosen = F.lit(None).cast("string")
    for i, rung in enumerate(rungs):
        every = peers.groupBy(*rung).agg(F.count("*").alias(f"__all{i}"))
        mine = peers.groupBy(*rung, own).agg(F.count("*").alias(f"__own{i}"))
        out = out.join(every, rung, "left").join(mine, [*rung, own], "left")
        n = F.coalesce(f"__all{i}", F.lit(0)) - F.coalesce(f"__own{i}", F.lit(0))
        out = out.withColumn(f"__n{i}", n)
    for i in reversed(range(len(rungs))):
        chosen = F.when(F.col(f"__n{i}") >= floor, "+".join(rungs[i])).otherwise(chosen)
    count = F.coalesce(*[F.when(F.col(f"__n{i}") >= floor, F.col(f"__n{i}")) for i in range(len(rungs))], F.lit(0))
    return out.select(key, F.coalesce(chosen, F.lit("unavailable")).alias("rung"), count.cast("long").alias("n_peers"))


def peer_curves(rows: DataFrame, peer_set: list[str], index: str, value: str, *, floor: int = 20, length: str | None = None) -> DataFrame:
    """P10, P50 and P90 of a peer set by month, absolute and per thousand of length.

    Curves are made once per peer set; fewer than ``floor`` peers are
    ``insufficient`` and have no values.
    """
    names = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    aggs = [F.count(value).alias("n"), *[F.percentile(value, f).alias(n) for n, f in names.items()]]
    if length:
        per = F.col(value) / (F.col(length) / 1000)
        aggs += [F.percentile(per, f).alias(f"{n}_per_k") for n, f in names.items()]
    out = rows.groupBy(*peer_set, index).agg(*aggs)
    enough = F.col("n") >= floor
    values = [c for c in out.columns if c.startswith("p1") or c.startswith("p5") or c.startswith("p9")]
    return out.withColumns({c: F.when(enough, F.col(c)) for c in values} | {"status": F.when(enough, "available").otherwise("insufficient")})


def visible(value: str, available: str, cutoff: Column) -> Column:
    """A value only if it could be known at the cutoff."""
    return F.when(F.col(available) <= cutoff, F.col(value))


def guarded_feature(value: str, knowable: str, anchor: str) -> tuple[Column, Column]:
    """A feature value with its state: unavailable, leakage or observed."""
    state = F.when(F.col(knowable).isNull(), "unavailable").when(F.col(knowable) > F.col(anchor), "leakage").otherwise("observed")
    return F.when(state == "observed", F.col(value)), state


def feature_snapshot(subjects: DataFrame, anchors: DataFrame, aliases: DataFrame, key: str, *, raw: str, as_of: Column) -> DataFrame:
    """Anchored subjects with their alias status: resolved, missing or conflict."""
    anchor = anchors.where(F.col("available_on") <= as_of).groupBy(key).agg(F.min("event_day").alias("anchor_day"))
    seen = aliases.where(F.col("effective_from") <= as_of)
    names = seen.groupBy(raw).agg(F.count_distinct("formation").alias("__n"), F.min("formation").alias("__one"))
    joined = subjects.join(anchor, key, "left").join(names, raw, "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "conflict").otherwise("resolved")
    timing = F.when(F.col("anchor_day").isNull(), "no_anchor").when(F.col("anchor_day") > as_of, "after_cut").otherwise("anchored")
    return joined.select(*subjects.columns, "anchor_day", timing.alias("anchor_status"), status.alias("alias_status"), F.when(status == "resolved", F.col("__one")).alias("formation"))


def pool_status(rows: DataFrame, key: str, formation: str, confidence: str, floor: float) -> DataFrame:
    """Classify a key by its pools: all must map, and to one formation, with confidence."""
    n, known, sure = F.count("*"), F.count(formation), F.count_if(F.col(confidence) >= floor)
    kinds = F.count_distinct(F.when(F.col(confidence) >= floor, F.col(formation)))
    sums = rows.groupBy(key).agg(n.alias("n"), known.alias("known"), sure.alias("sure"), kinds.alias("kinds"), F.min(formation).alias("one"))
    status = F.when(F.col("known") == 0, "alias_unavailable").when(F.col("known") < F.col("n"), "pool_unavailable").when(F.col("sure") < F.col("n"), "below_confidence").when(F.col("kinds") > 1, "conflict").otherwise("mapped")
    return sums.select(key, status.alias("status"), F.when(status == "mapped", F.col("one")).alias(formation))


def producing_class(keys: DataFrame, rows: DataFrame, key: str, month: str, value: str, *, months: int = 3, unknown: Column | None = None) -> DataFrame:
    """producing / not_producing over the newest months; keys without rows are unknown.

    The window ends at the newest month of all rows; absence of rows is not the
    same as absence of production.
    """
    anchor = rows.agg(F.max(F.trunc(month, "MM")).alias("__anchor"))
    inside = rows.crossJoin(F.broadcast(anchor)).where(F.trunc(F.col(month), "MM") > F.add_months(F.col("__anchor"), -months))  # anchor: one row
    flags = inside.groupBy(key).agg(F.bool_or(F.col(value) > 0).alias("__any"))
    named = F.when(F.col("__any"), "producing").when(~F.col("__any"), "not_producing").otherwise("unknown")
    if unknown is not None:
        named = F.when(unknown, "unknown").otherwise(named)
    return keys.join(flags, key, "left").withColumn("class", named).drop("__any")

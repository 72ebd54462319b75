"""Reads on two clocks: heads, as-of cuts, registries, as-of joins."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], *, rank: str | None = None) -> DataFrame:
    """The first row of each key under a full order (DISTINCT ON)."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1)
    return ranked.drop(name)


def latest(df: DataFrame, keys: list[str], vintage: str, tiebreak: list[str | Column], *, as_of: Column | None = None) -> DataFrame:
    """Latest-known row per key; the as-of cut comes before the ranking.

    Ties of the vintage are broken by ``tiebreak``, all descending with nulls
    last, so that the survivor never depends on row order.
    """
    seen = df if as_of is None else df.where(F.col(vintage) <= as_of)
    order = [F.desc_nulls_last(vintage), *(t.desc_nulls_last() if isinstance(t, Column) else F.desc_nulls_last(t) for t in tiebreak)]
    return first_per_key(seen, keys, order)


def available_on(*clocks: str | Column) -> Column:
    """The day a fact could first be known: the latest of its clocks, absent ones aside."""
    return F.greatest(*[F.col(c) if isinstance(c, str) else c for c in clocks])


def available_facts(facts: DataFrame, manifests: DataFrame, derivations: DataFrame, as_of: Column, *, manifest_key: str, derivation_key: str) -> DataFrame:
    """Facts whose report, fetch and creation all lie at or before ``as_of``.

    The two dimension joins are plain equi joins, so Spark broadcasts whichever
    side its own size statistics allow.
    """
    known = facts.join(manifests, manifest_key).join(derivations, derivation_key)
    day = available_on("report_vintage", "fetch_vintage", F.coalesce(F.col("created_vintage"), F.col("fetch_vintage")))
    return known.withColumn("available_on", day).where(F.col("available_on") <= as_of)


def registry_as_of(df: DataFrame, code: str, knowledge: Column, valid: Column, *, effective: str = "effective_from", published: str = "published_at") -> DataFrame:
    """The version of each registry row in force at two clocks."""
    seen = df.where((F.col(published) <= knowledge) & (F.col(effective) <= valid))
    return first_per_key(seen, [code], [F.desc(effective), F.desc(published)])


def rules_in_force(rules: DataFrame, knowledge: Column, valid: Column) -> DataFrame:
    """Published, effective and not superseded by another rule in force."""
    live = rules.where(
        (F.col("published_vintage") <= knowledge)
        & (F.col("effective_from") <= valid)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > valid))
    )
    gone = live.select(F.col("supersedes_rule_id").alias("rule_id")).where("rule_id is not null")
    return live.join(gone, "rule_id", "left_anti")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, effective: str, prefer: list[str] | None = None) -> DataFrame:
    """Each left row with the right row in force at its time, or nulls.

    Both sides are laid in one sequence per key, by time, and the best right row
    so far is carried forward: the largest by ``prefer`` (columns of the right
    side), then the latest. A key's history is read once, not joined with each
    of its left rows. Right columns other than the keys are added. Null keys and
    null times match nothing; every left row stays, repeated ones too.
    """
    ahead = [*(prefer or []), effective]
    added = [c for c in right.columns if c not in keys]
    carried = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*ahead, *(c for c in added if c not in ahead)])])
    order = [*ahead, *(c for c in added if c not in ahead)]
    known = reduce(operator.and_, [F.col(k).isNotNull() for k in keys], F.col(effective).isNotNull())
    rows = right.where(known).select(*keys, F.col(effective).alias("__at"), F.lit(0).alias("__asks"), carried.alias("__right"))
    asked = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__asks"), F.struct(*left.columns).alias("__left"))
    sequence = Window.partitionBy(*keys).orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked, allowMissingColumns=True).withColumn("__best", F.max("__right").over(sequence)).where("__asks = 1")
    return both.select(*(F.col("__left").getField(c).alias(c) for c in left.columns), *(F.col("__best").getField(f"_{order.index(c)}").alias(c) for c in added))


def membership_as_of(members: DataFrame, group: str, effective: str, as_of: Column, *, per_group: bool = True) -> DataFrame:
    """Membership rows of the newest edition: each group's own, or one for all."""
    seen = members.where(F.col(effective) <= as_of)
    scope = Window.partitionBy(group)
    if per_group:
        return seen.withColumn("__newest", F.max(effective).over(scope)).where(F.col(effective) == F.col("__newest")).drop("__newest")
    newest = seen.agg(F.max(effective).alias("__newest"))
    return seen.join(F.broadcast(newest), seen[effective] == newest["__newest"]).drop("__newest")  # one row


def effective_fan_out(left: DataFrame, right: DataFrame, keys: list[str], at: str, effective: str, value: str) -> DataFrame:
    """All distinct values in force at a row's time; one null row where there is none."""
    r = right.select(*keys, effective, value).withColumnRenamed(effective, "__from")
    condition = [left[k] == r[k] for k in keys] + [r["__from"] <= left[at]]
    out = left.join(r, condition, "left")
    for k in keys:
        out = out.drop(r[k])
    return out.drop("__from").distinct()


def vintage_bounds(df: DataFrame, key: str, vintage: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(vintage).alias("first_vintage"), F.max(vintage).alias("last_vintage"))


def refuse_before_first(df: DataFrame, vintage: str, as_of) -> DataFrame:
    """The rows known at ``as_of``; a date before any knowledge is refused, not answered empty."""
    first = df.agg(F.min(vintage)).first()[0]
    if first is not None and as_of < first:
        raise ValueError(f"nothing is known before {first}")
    return df.where(F.col(vintage) <= F.lit(as_of))

"""Append-only facts: change-only batches, collisions, divergence, quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.temporal import latest


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def changed_only(batch: DataFrame, heads: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Batch rows that are new or whose value differs from the head's, nulls included."""
    head = heads.select(*keys, F.col(value).alias("__head"), F.lit(True).alias("__known"))
    joined = batch.join(head, _same(batch, head, keys), "left")
    fresh = joined.where(F.col("__known").isNull() | ~F.col(value).eqNullSafe(F.col("__head")))
    return fresh.select(*[batch[c] for c in batch.columns])


def unseen_only(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not stored yet (NOT EXISTS; null parts compare equal)."""
    return batch.join(existing, _same(batch, existing, keys), "left_anti")


def diverged(batch: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of the same vintage whose values differ from those on record."""
    other = stored.select(*keys, F.struct(*values).alias("__stored"))
    joined = batch.join(other, _same(batch, other, keys))
    return joined.where(~F.struct(*[batch[v] for v in values]).eqNullSafe(F.col("__stored"))).select(*[batch[c] for c in batch.columns])


def withdrawn(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on record that a rerun no longer computes."""
    return stored.join(batch, _same(stored, batch, keys), "left_anti")


def refuse_any(df: DataFrame, message: str) -> None:
    """Stop the run if the frame has a row; looks at one row only."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def self_diverged(batch: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that a batch files with several values, nulls counted as one: ``keys, low, high``."""
    values = F.struct(F.col(value).alias("value"))
    both = batch.groupBy(*keys).agg(F.min(values).alias("low"), F.max(values).alias("high")).where(~F.col("low").eqNullSafe(F.col("high")))
    return both.select(*keys, "low.value", F.col("high.value").alias("other"))


def bitemporal_append(store: DataFrame, batch: DataFrame, keys: list[str], vintage: str, value: str) -> DataFrame:
    """Rows to append: same-vintage divergence is refused, unchanged values are left out.

    A key and vintage may neither differ from what is stored nor be filed with
    two values in the batch itself; rows that are filed again with the same
    value count once (one of them stays). Only the store's rows of the batch's
    keys are ranked for heads, so a small batch reads a store that is bucketed
    or partitioned by key without sorting it.
    """
    at = [*keys, vintage]
    refuse_any(self_diverged(batch, at, value), "one vintage filed with two values")
    once = batch.dropDuplicates([*at, value])
    refuse_any(diverged(once, store, at, [value]), "same vintage, different value")
    asked = once.select(*keys).distinct()
    known = store.join(asked, _same(store, asked, keys), "left_semi")
    heads = latest(known, keys, vintage, [value])
    return changed_only(unseen_only(once, known, at), heads, keys, value)


def route_collisions(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """Mark rows ``kept``, ``duplicate`` (equal value again) or ``collision`` (values differ).

    A key with differing values promotes nothing: all of its rows collide.
    """
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*order))
    differ = F.min(value).over(w) != F.max(value).over(w)
    return df.withColumn("route", F.when(differ, "collision").when(place == 1, "kept").otherwise("duplicate"))


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def signatures(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Row count and an order-free digest of a key's members."""
    pair = F.struct(F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("xor"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), pair.alias("signature"))


def changed_keys(new: DataFrame, old: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Keys whose members changed since the older partition; whole keys are skipped else."""
    a, b = signatures(new, keys, member), signatures(old, keys, member)
    return a.join(b, [*keys, "n", "signature"], "left_anti").select(*keys)


def revisions(store: DataFrame, updates: DataFrame, key: str, effective: str, fields: list[str], at: Column) -> DataFrame:
    """Latest rows carried forward with changed fields at a new effective date.

    Unchanged rows are left out; a row already at or past the date aborts.
    """
    head = latest(store, [key], effective, sorted(set(store.columns) - {key, effective}))
    new = updates.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = head.join(new, key)
    differs = reduce(lambda x, y: x | y, [F.col(f"__{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields])
    moved = joined.where(differs)
    refuse_any(moved.where(F.col(effective) >= at).select(key, effective), "a row is already at or past the date")
    out = moved.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields} | {effective: at})
    return out.select(*store.columns)


PAYLOAD_LIMIT = 8192


def quarantine_rows(rejected: DataFrame, source_id: str, stage: str, seen_at: Column) -> DataFrame:
    """Observations for the ledger: fingerprint, reason, bounded JSON payload."""
    fields = sorted(set(rejected.columns) - {"reason_code", "rule_id"})
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    fingerprint = F.sha2(F.concat_ws("|", F.lit(source_id), F.lit(stage), "reason_code", "rule_id", payload), 256)
    bounded = F.when(F.octet_length(payload) <= PAYLOAD_LIMIT, payload).otherwise(F.to_json(F.struct(F.lit(True).alias("payload_withheld"))))
    return rejected.select(
        fingerprint.alias("row_fingerprint"), F.lit(source_id).alias("source_id"), F.lit(stage).alias("stage"),
        "reason_code", "rule_id", bounded.alias("row_payload"), seen_at.alias("seen_at"),
    )


def quarantine_ledger(observations: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """One row per fingerprint: times seen, first and last sight, state.

    The ledger is an append log with this view over it, so nothing is updated
    in place. ``releases`` has ``row_fingerprint, state, released_at_vintage``.
    """
    ledger = observations.groupBy("row_fingerprint", "source_id", "stage", "reason_code", "rule_id", "row_payload").agg(
        F.count("*").alias("occurrence_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )
    if releases is None:
        return ledger.withColumns({"state": F.lit("open"), "released_at_vintage": F.lit(None).cast("date")})
    return ledger.join(releases, "row_fingerprint", "left").withColumn("state", F.coalesce("state", F.lit("open")))


def open_as_of(ledger: DataFrame, as_of: Column) -> DataFrame:
    return ledger.where((F.col("state") == "open") | (F.col("released_at_vintage") > as_of))


def unreferenced(rows: DataFrame, references: DataFrame, key: str, created: str, cutoff: Column) -> DataFrame:
    """Ephemeral rows past their keep time that nothing refers to."""
    old = rows.where(F.col(created) < cutoff)
    return old.join(references.select(key), key, "left_anti")

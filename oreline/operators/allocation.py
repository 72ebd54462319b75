"""Equal-share allocation of a group's volume to its eligible members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(month: Column, completion: Column, plug: Column) -> Column:
    """Completed by the month and not plugged before it; an absent date is no bound."""
    return F.coalesce(completion <= month, F.lit(True)) & ~F.coalesce(month > plug, F.lit(False))


def equal_shares(df: DataFrame, keys: list[str], member: str, volume: str, ok: str) -> DataFrame:
    """Split a whole-number volume equally, without a remainder lost.

    The share is the floor of the size over the eligible members; what is left
    goes to the smallest member; the sign is put back last, so negative
    corrections split like positive volumes. Members that aren't eligible get 0.
    """
    w = Window.partitionBy(*keys)
    n = F.count_if(F.col(ok)).over(w)
    first = F.min(F.when(F.col(ok), F.col(member))).over(w)
    size = F.abs(F.col(volume))
    base = F.floor(size / F.nullif(n, F.lit(0))).cast("long")
    share = F.when(F.col(ok), base + F.when(F.col(member) == first, size - base * n).otherwise(0)).otherwise(0)
    return df.withColumns({"n_eligible": n, "share": (F.signum(F.col(volume).cast("double")).cast("long") * share).cast("long")})


def unallocated_cause(members: DataFrame, groups: DataFrame, keys: list[str], *, month: str, completion: str, plug: str) -> DataFrame:
    """Why a group's volume finds no member: one cause per group without an eligible one."""
    joined = groups.join(members, keys, "left")
    after, plugged = F.col(completion) > F.col(month), F.col(plug) < F.col(month)
    ok = eligible(F.col(month), F.col(completion), F.col(plug)) & F.col("member").isNotNull()
    sums = joined.groupBy(*keys).agg(
        F.count("member").alias("n"), F.count_if(ok).alias("ok"), F.count_if(after).alias("after"), F.count_if(plugged).alias("plugged")
    )
    cause = F.when(F.col("n") == 0, "no_crosswalk_row").when(F.col("after") == F.col("n"), "all_after_month").when(F.col("plugged") == F.col("n"), "all_plugged_before_month").otherwise("no_eligible_member")
    return sums.where("ok = 0").select(*keys, cause.alias("cause"))


def conservation(shares: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """Allocated against filed volume per group; the residual must be zero where any member is eligible."""
    sums = shares.groupBy(*keys).agg(F.max(volume).alias("filed"), F.sum("share").alias("allocated"), F.max("n_eligible").alias("n_eligible"))
    return sums.withColumn("residual", F.col("filed") - F.col("allocated"))

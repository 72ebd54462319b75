"""Due jobs and their order; registry rows in, a plan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day_of_month(month: Column, number: Column) -> Column:
    """That day of a month, or its last one where it is shorter."""
    return F.date_add(F.trunc(month, "MM"), F.least(number, F.dayofmonth(F.last_day(month))) - 1)


def next_due(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with their next due time and whether they are due now.

    ``jobs`` has ``job, kind (cadence, monthly, after), every_days, month_day,
    last_success`` and, for jobs that follow another, ``after_job``. A cadence or
    monthly job that never ran is due at once; monthly days beyond a month's end
    fall on its last day. A job that follows another is due since that one's
    last success, if its own is older or missing, and has no due time otherwise.
    """
    this_month = _day_of_month(now, F.col("month_day"))
    monthly = F.when(F.col("last_success") >= this_month, _day_of_month(F.add_months(now, 1), F.col("month_day"))).otherwise(this_month)
    timed = F.when(F.col("last_success").isNull(), now).when(F.col("kind") == "cadence", F.date_add("last_success", F.col("every_days"))).when(F.col("kind") == "monthly", monthly)
    if "after_job" in jobs.columns:
        parents = jobs.select(F.col("job").alias("__parent"), F.col("last_success").alias("__ran"))
        rows = jobs.join(parents, F.col("after_job") == F.col("__parent"), "left")
        followed = F.when(F.col("last_success").isNull() | (F.col("__ran") > F.col("last_success")), F.col("__ran"))
    else:
        rows, followed = jobs.withColumns({"__parent": F.lit(None), "__ran": F.lit(None)}), F.lit(None).cast("date")
    due = F.when(F.col("kind") == "after", followed).otherwise(timed)
    return rows.withColumn("next_due", due).withColumn("due", F.coalesce(F.col("next_due") <= now, F.lit(False))).drop("__parent", "__ran")


def plan_key(job: Column, now: Column) -> Column:
    """Idempotent key of a job's run within an hour."""
    return F.sha2(F.concat_ws("|", job, F.date_format(now, "yyyy-MM-dd'T'HH")), 256)


def layers(jobs: list[str], needs: list[tuple[str, str]]) -> tuple[list[list[str]], list[str]]:
    """Dependency layers and what a cycle keeps from being ordered.

    The registry of jobs is small and lives on the driver.
    """
    open_, done, out = set(jobs), set(), []
    wants = {j: {b for a, b in needs if a == j} for j in jobs}
    while ready := sorted(j for j in open_ if wants[j] <= done):
        out.append(ready)
        done |= set(ready)
        open_ -= set(ready)
    return out, sorted(open_)


def rate_windows(calls: DataFrame, principal: str, at: str, limit: int) -> DataFrame:
    """Calls per principal and minute, and how many of them a fixed window refuses."""
    counts = calls.groupBy(principal, F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("n"))
    return counts.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)))

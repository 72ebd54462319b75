"""Aggregations: cumulatives, month censuses, facets, rollups, quantiles, digests."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalar import ADMITTED, months_apart
from oreline.storage import written


def restricted(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Push a membership below an aggregate; Catalyst does not do that by itself."""
    return df.join(members.select(*keys), keys, "left_semi")


def stream_totals(df: DataFrame, keys: list[str], stream: str, value: str, fold: dict[str, str], fact: str | None = None) -> DataFrame:
    """Totals of folded streams (say oil and condensate as liquid) over admitted facts."""
    table = F.create_map(*[F.lit(x) for kv in fold.items() for x in kv])
    admitted = df if fact is None else df.where(F.col(fact).isin(*ADMITTED))
    return admitted.withColumn(stream, F.coalesce(F.try_element_at(table, F.col(stream)), F.col(stream))).groupBy(*keys, stream).agg(F.sum(value).alias(value))


def filtered_sums(df: DataFrame, keys: list[str], stream: str, value: str, streams: dict[str, list[str]], fact: str | None = None) -> DataFrame:
    """One row per key with a filtered sum for each named set of streams."""
    ok = F.col(fact).isin(*ADMITTED) if fact else F.lit(True)
    return df.groupBy(*keys).agg(*[F.sum(F.when(ok & F.col(stream).isin(*members), F.col(value))).alias(name) for name, members in streams.items()])


def month_census(rows: DataFrame, keys: list[str], month: str, label: str, strength: list[str]) -> DataFrame:
    """Disjoint month classes that add up to the span from first to last month.

    The strongest label of a month counts; months of the span without a row
    count as ``absent``.
    """
    rank = reduce(lambda acc, il: acc.when(F.col(label) == il[1], il[0]), list(enumerate(strength))[1:], F.when(F.col(label) == strength[0], 0))
    per_month = rows.groupBy(*keys, month).agg(F.min(rank).alias("__rank"))
    counts = [F.count_if(F.col("__rank") == i).alias(name) for i, name in enumerate(strength)]
    out = per_month.groupBy(*keys).agg(*counts, F.count("*").alias("__n"), F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    span = months_apart("last_month", "first_month") + 1
    return out.withColumn("span", span.cast("long")).withColumn("absent", (F.col("span") - F.col("__n")).cast("long")).drop("__n")


def coverage_sums(df: DataFrame, keys: list[str], value: str, allocated: str) -> DataFrame:
    """Outcome of a key, its volume and the part of it that was allocated: ``outcome, whole, part``."""
    whole, part = F.sum(F.abs(F.col(value))), F.sum(F.when(F.col(allocated), F.abs(F.col(value))).otherwise(0))
    out = df.groupBy(*keys).agg(whole.alias("whole"), part.alias("part"), F.bool_or(allocated).alias("__any"))
    outcome = F.when(F.col("whole").isNull(), "never_reported").when(F.col("__any"), "observed_with_allocated").otherwise("observed")
    return out.select(*keys, outcome.alias("outcome"), "whole", "part")


def coverage(df: DataFrame, keys: list[str], value: str, allocated: str, *, digits: int = 4) -> DataFrame:
    """Outcome of a key and the share of its volume that was allocated, rounded to ``digits`` decimals (7 at most).

    The share is rounded once, by whole numbers: a quotient of decimals is
    itself rounded to ten places, which would lift what lies just below a half.
    """
    whole, part = (F.col(c).cast("decimal(28,6)") for c in ("whole", "part"))
    places = F.call_function("div", part * F.lit(2 * 10**digits).cast(f"decimal({digits + 1},0)") + whole, whole * F.lit(2).cast("decimal(1,0)"))
    share = F.when(F.col("whole") > 0, (places.cast("decimal(18,0)") / F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast(f"decimal(18,{digits})"))
    return coverage_sums(df, keys, value, allocated).select(*keys, "outcome", share.alias("allocated_share"))


def pool_rollup(df: DataFrame, keys: list[str], pool: str, value: str, days: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Pool filings to entity rows: exact sums where pools differ, one row kept where they don't.

    Two or more different pools sum (days take the largest); one filing passes;
    filings that repeat a pool can't be told apart, so the first by ``order``
    stays and the rest are rejected.
    """
    w = Window.partitionBy(*keys)
    marked = df.withColumns({"__n": F.count("*").over(w), "__pools": F.size(F.collect_set(pool).over(w)), "__place": F.row_number().over(w.orderBy(order))})
    summed = marked.where("__n >= 2 AND __pools = __n").groupBy(*keys).agg(
        F.sum(value).alias(value), F.max(days).alias(days), F.count("*").alias("n_filings"), F.lit("sum_over_pools").alias("aggregation")
    )
    single = marked.where("__n = 1 OR (__pools < __n AND __place = 1)").select(
        *keys, value, days, F.lit(1).cast("long").alias("n_filings"), F.when(F.col("__n") == 1, "single").otherwise("first_of_repeated").alias("aggregation")
    )
    rejected = marked.where("__n > 1 AND __pools < __n AND __place > 1").drop("__n", "__pools", "__place").withColumn("reason_code", F.lit("repeated_pool"))
    return summed.unionByName(single), rejected


def facets(df: DataFrame, value: str, count_of: str | None = None, *, top: int = 5, search: Column | None = None) -> DataFrame:
    """Counts per value with the remainder, the null bucket and the totals in one pass.

    Rows are ``kind`` (``value, remainder, null, matched, scope``), ``value`` (as
    text) and ``n``; ties of the ranking go to the smaller value. The facet is counted
    once, in one scan. The counts are ranked in as many parts as Spark shuffles
    to, and the first rows of each part meet in one row with the totals, so many
    distinct values meet in no one task; the remainder is what the top rows leave.
    """
    n = F.count_distinct(count_of) if count_of else F.count("*")
    hit = F.coalesce(search, F.lit(False)) if search is not None else F.col(value).isNotNull()
    counts = df.groupBy(value).agg(n.alias("n")).select(F.col(value).cast("string").alias("value"), "n", hit.alias("hit"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_part = Window.partitionBy(F.pmod(F.xxhash64("value"), F.lit(parts))).orderBy(F.desc("hit"), F.desc("n"), F.asc("value"))
    leads = F.when(F.col("hit") & (F.row_number().over(in_part) <= top), F.struct((-F.col("n")).alias("m"), "value"))
    whole = counts.withColumn("leads", leads).agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched"),
        F.sum("n").alias("scope"),
        F.sum(F.when(F.col("value").isNull() & ~F.col("hit"), F.col("n")).otherwise(0)).alias("empty"),
        F.slice(F.array_sort(F.collect_list("leads")), 1, top).alias("first"),
    )
    row = lambda kind, v, n: F.struct(F.lit(kind).alias("kind"), v.alias("value"), n.alias("n"))
    none, shown = F.lit(None).cast("string"), F.aggregate("first", F.lit(0).cast("long"), lambda acc, s: acc - s["m"])
    rest = F.array(row("remainder", none, F.col("matched") - shown), row("null", none, F.col("empty")), row("matched", none, F.col("matched")), row("scope", none, F.col("scope")))
    rest = F.filter(rest, lambda r: (r["n"] > 0) | r["kind"].isin("matched", "scope"))
    return whole.select(F.inline(F.concat(F.transform("first", lambda s: row("value", s["value"], -s["m"])), rest)))


def dense_counts(df: DataFrame, keys: list[str], label: str, vocabulary: list[str]) -> DataFrame:
    """Counts over the whole vocabulary, so that zero is a row, with a total per key."""
    per_key = df.groupBy(*keys).agg(*[F.count_if(F.col(label) == v).alias(f"c{i}") for i, v in enumerate(vocabulary)])
    pairs = ", ".join(f"'{v}', c{i}" for i, v in enumerate(vocabulary))
    total = " + ".join(f"c{i}" for i in range(len(vocabulary)))
    return per_key.select(*keys, F.expr(f"stack({len(vocabulary) + 1}, {pairs}, 'total', {total}) AS ({label}, n)"))


def banded(df: DataFrame, value: str, bands: list[tuple[str, int, int | None]]) -> DataFrame:
    """Histogram over inclusive integer bands."""
    v = F.col(value)
    test = lambda b: (v >= b[1]) & (v <= b[2]) if b[2] is not None else v >= b[1]
    name = reduce(lambda acc, b: acc.when(test(b), b[0]), bands[1:], F.when(test(bands[0]), bands[0][0]))
    return df.withColumn("band", name).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with running ranks ``__upto`` of ``__n``, for any number of rows per key.

    The counts per value are range-partitioned by key and value and written;
    running sums are taken per slice, and the totals of the slices before are
    added. So a key with a third of all rows, or a table without keys, is spread
    over all tasks; the one window per key sees a row per slice.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    sliced = written(counts.repartitionByRange(*keys, value).withColumn("__slice", F.spark_partition_id()), "value-counts")
    per_slice = sliced.groupBy(*keys, "__slice").agg(F.sum("__c").alias("__in"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = F.coalesce(F.sum("__in").over(by_key.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_slice.select("__slice", *(F.col(k).alias(f"__of_{k}") for k in keys), earlier.alias("__before"), F.sum("__in").over(by_key).alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    inside = Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("__inside", F.sum("__c").over(inside)).withColumnRenamed("__slice", "__at")
    joined = placed.join(offsets, reduce(operator.and_, same, F.col("__at") == F.col("__slice")))
    return joined.withColumn("__upto", F.col("__before") + F.col("__inside")).select(*keys, value, "__c", "__upto", "__n")


def _at_rank(place: Column, value: str) -> Column:
    """The value at a rank from one on: the least that this many rows don't exceed."""
    return F.min(F.when(F.col("__upto") >= place, F.col(value)))


def continuous_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, without a key in one task."""
    counted = _counted(df, keys, value)
    at = {n: (F.col("__n") - 1) * F.lit(float(f)) for n, f in fractions.items()}
    ends = [x for n, p in at.items() for x in (_at_rank(F.floor(p) + 1, value).alias(f"__low_{n}"), _at_rank(F.ceil(p) + 1, value).alias(f"__high_{n}"))]
    found = counted.groupBy(*keys).agg(*ends, F.max("__n").alias("__n"))

    def between(n: str, p: Column) -> Column:
        low, high = F.col(f"__low_{n}"), F.col(f"__high_{n}")
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*keys, *(between(n, p).alias(n) for n, p in at.items()), F.col("__n").alias("n"))


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, tuple[int, int]], rule: str = "nearest") -> DataFrame:
    """Percentiles that are data values; fractions are exact, as (numerator, denominator).

    ``nearest`` takes rank ``ceil(f n)``; ``floor`` takes the value at zero-based
    place ``min(n - 1, floor(f n))``. The two differ where ``f n`` is whole.
    """
    counted = _counted(df, keys, value)

    def place(f: tuple[int, int]) -> Column:
        product = F.col("__n") * F.lit(f[0])
        if rule == "nearest":
            return F.greatest(F.lit(1), F.ceil(product / F.lit(f[1])))
        return F.least(F.col("__n"), F.floor(product / F.lit(f[1])) + 1)

    return counted.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") >= place(f), F.col(value))).alias(n) for n, f in fractions.items()], F.max("__n").alias("n"))


def bin_edges(df: DataFrame, value: str, fractions: tuple[float, ...] = (0.02, 0.2, 0.4, 0.6, 0.8, 0.98)) -> DataFrame:
    """One row: least, percentile and largest values of the positive cells."""
    positive = df.where(F.col(value) > 0)
    names = {f"p{i}": f for i, f in enumerate((0.0, *fractions, 1.0))}
    return continuous_percentiles(positive, [], value, names).select(F.array(*names).alias("edges"))


def binned(df: DataFrame, value: str, edges: DataFrame, name: str = "bin") -> DataFrame:
    """Bin numbers 0 to 6 by the number of edges at or below; -1 for what isn't positive."""
    at_or_below = F.size(F.filter("edges", lambda e: e <= F.col(value))) - 1
    number = F.when(F.col(value) > 0, F.greatest(F.lit(0), F.least(at_or_below, F.size("edges") - 2))).otherwise(-1)
    return df.crossJoin(F.broadcast(edges)).withColumn(name, number).drop("edges")  # edges: one row


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: counts and sums of row hashes, no global sort."""
    h1, h2 = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    return df.agg(F.count("*").alias("n"), F.sum(h1.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h2).alias("xor")).select(
        "n", F.sha2(F.concat_ws(":", "n", "sum", "xor"), 256).alias("digest")
    )


def group_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """MD5 over the sorted MD5s of a group's rows, for small groups that another engine checks."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return df.groupBy(*keys).agg(F.md5(F.concat_ws("", F.array_sort(F.collect_list(row))).cast("binary")).alias("digest"), F.count("*").alias("n"))


def series(df: DataFrame, keys: list[str], axis: str, columns: list[str]) -> DataFrame:
    """Parallel arrays over one sorted axis."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, *columns))).alias("__rows"))
    return rows.select(*keys, *[F.col("__rows").getField(c).alias(c) for c in [axis, *columns]])


def month_axis(frames: list[DataFrame], keys: list[str], month: str) -> DataFrame:
    """Distinct months of several frames."""
    return reduce(DataFrame.union, [f.select(*keys, month) for f in frames]).distinct()


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def symmetric_errors(df: DataFrame, keys: list[str], estimate: str, truth: str) -> DataFrame:
    """Error (a - t) / (a + t) per row with the two exclusions named."""
    a, t = F.coalesce(F.col(estimate), F.lit(0)), F.coalesce(F.col(truth), F.lit(0))
    excluded = F.when((a < 0) | (t < 0), "negative").when((a == 0) & (t == 0), "both_zero")
    return df.select(*keys, F.when(excluded.isNull(), (a - t) / (a + t)).alias("error"), excluded.alias("excluded"))


def gate(observed: Column, limit: Column, *, floor: bool) -> Column:
    """pass, fail or not_evaluable of a share against a floor or a ceiling."""
    ok = observed >= limit if floor else observed <= limit
    return F.when(observed.isNull(), "not_evaluable").when(ok, "pass").otherwise("fail")


def crosswalk(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """Sorted members per key on both sides, and how the sides compare."""
    a = left.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("left_members"))
    b = right.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("right_members"))
    kind = F.when(F.col("right_members").isNull(), "only_left").when(F.col("left_members").isNull(), "only_right").when(F.col("left_members") != F.col("right_members"), "different").otherwise("agree")
    return a.join(b, key, "full_outer").withColumn("comparison", kind)


def status_census(df: DataFrame, keys: list[str], derivation: str) -> DataFrame:
    """Many-key census; coarser counts are sums of this frame."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(derivation)).alias("derivations"))


def source_health(attempts: DataFrame, source: str, key: str, started: str, state: str, manifest: str) -> DataFrame:
    """Per source: keys whose latest attempt is open or failed, oldest open start, manifests."""
    w = Window.partitionBy(source, key).orderBy(F.desc(started), F.desc(manifest))
    last = attempts.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return last.groupBy(source).agg(
        F.count_if(F.col(state) == "open").alias("open_keys"),
        F.count_if(F.col(state) == "failed").alias("failed_keys"),
        F.min(F.when(F.col(state) == "open", F.col(started))).alias("oldest_open"),
        F.max_by(key, F.when(F.col(state) == "failed", F.struct(started, key))).alias("last_failed_key"),
        F.count_distinct(manifest).alias("n_manifests"),
    )


def dataset_inventory(df: DataFrame, source: str, month: str, entity: str, vintage: str) -> DataFrame:
    return df.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.count_distinct(month).alias("n_months"), F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        F.count_distinct(entity).alias("n_entities"), F.max(vintage).alias("last_vintage"),
    )


def coverage_counters(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """Counts of each status by key, one column each, and the share of the first."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == v).alias(v) for v in values])
    return counts.withColumn("share", F.round(F.col(values[0]).cast("decimal(18,0)") / F.col("n").cast("decimal(18,0)"), 6))

"""Model frames and planning: labels, splits, ladders, curves, producing classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import modeling as M
from oreline.operators import scheduling
from oreline.plans.registry import Tables, cents, day, query

# Months of a customer's orders with two streams, F and O, as sums of cents.
_MONTHLY = """
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mo, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') AS a, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') AS b,
  bool_or(o_orderstatus = 'P' AND o_totalprice > 250000) AS held FROM orders GROUP BY 1, 2)
"""


def _monthly(t: Tables):
    v = cents("o_totalprice")
    return t.orders.groupBy("o_custkey", F.trunc(day("o_orderdate"), "MM").alias("mo")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", v)).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "O", v)).alias("b"),
        F.when(F.bool_or((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000)), "withheld").otherwise("reported").alias("fact"),
    )


@query("labels_12", _MONTHLY + """,
p AS (SELECT *, coalesce(a, 0) > 0 OR coalesce(b, 0) > 0 AS prod, year(mo) * 12 + month(mo) - 1 AS i FROM m),
k AS (SELECT *, CASE WHEN prod THEN sum(prod::INTEGER) OVER (PARTITION BY o_custkey ORDER BY mo ROWS UNBOUNDED PRECEDING) END AS k, min(CASE WHEN prod THEN i END) OVER (PARTITION BY o_custkey) AS f FROM p),
s AS (SELECT o_custkey, h.horizon, count(*) FILTER (k <= h.horizon) AS n, min(f) AS f, max(i) FILTER (k = h.horizon) AS last, count(*) FILTER (held) AS hidden,
  sum(a) FILTER (k <= h.horizon) AS va, count(a) FILTER (k <= h.horizon) AS ca, sum(b) FILTER (k <= h.horizon) AS vb, count(b) FILTER (k <= h.horizon) AS cb FROM k CROSS JOIN (VALUES (3), (5)) h(horizon) GROUP BY 1, 2),
l AS (SELECT o_custkey, horizon, n, f, last, hidden, 'a' AS stream, va AS v, ca AS c FROM s UNION ALL SELECT o_custkey, horizon, n, f, last, hidden, 'b', vb, cb FROM s),
z AS (SELECT *, CASE WHEN n = 0 THEN 'no_production' WHEN hidden > 0 THEN 'withheld' WHEN n < horizon THEN 'incomplete' WHEN last - f + 1 > horizon + 30 THEN 'intermittent' WHEN c < horizon THEN 'missing_stream_observation' ELSE 'complete' END AS status FROM l)
SELECT o_custkey, horizon, stream, status, CAST(CASE WHEN status = 'complete' THEN v END AS BIGINT) AS value FROM z""")
def labels_12(t: Tables):
    return M.cumulative_labels(_monthly(t), "o_custkey", "mo", ["a", "b"], "fact", horizons=(3, 5), slack=30)


@query("temporal_split", """
WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1), g AS (SELECT c_custkey, c_nationkey, d FROM customer JOIN f ON o_custkey = c_custkey),
m AS (SELECT c_nationkey, DATE '1970-01-01' + floor(quantile_cont((d - DATE '1970-01-01')::DOUBLE, 0.5))::INTEGER AS md FROM g GROUP BY 1)
SELECT c_custkey, CASE WHEN md >= DATE '1995-12-20' THEN 'test' WHEN md >= DATE '1995-12-20' - INTERVAL 1 MONTH THEN 'calibration' ELSE 'train' END AS split FROM g JOIN m USING (c_nationkey)""")
def temporal_split(t: Tables):
    first = t.orders.groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("d"))
    rows = t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"))
    return M.temporal_split(rows, "c_custkey", "c_nationkey", "d", F.lit("1995-12-20").cast("date"), calibration_months=1, most_share=None).select("c_custkey", "split")


@query("scl05_median_day", "SELECT o_orderpriority, strftime(DATE '1970-01-01' + floor(quantile_cont((CAST(o_orderdate AS DATE) - DATE '1970-01-01')::DOUBLE, 0.5))::INTEGER, '%Y-%m-%d') AS d FROM orders GROUP BY 1")
def scl05_median_day(t: Tables):
    return M.median_days(t.orders.select("o_orderpriority", day("o_orderdate").alias("d")), ["o_orderpriority"], "d").select("o_orderpriority", F.col("median_day").cast("string").alias("d"))


@query("peer_ladder", """
WITH s AS (SELECT p_partkey, p_brand, p_type, p_size // 10 AS sz, p_partkey % 40 AS own FROM part),
c AS (SELECT p_partkey, (SELECT count(*) FROM s q WHERE q.p_brand = s.p_brand AND q.p_type = s.p_type AND q.sz = s.sz AND q.own <> s.own) AS n0,
  (SELECT count(*) FROM s q WHERE q.p_brand = s.p_brand AND q.p_type = s.p_type AND q.own <> s.own) AS n1, (SELECT count(*) FROM s q WHERE q.p_brand = s.p_brand AND q.own <> s.own) AS n2 FROM s)
SELECT p_partkey, CASE WHEN n0 >= 15 THEN 'p_brand+p_type+sz' WHEN n1 >= 13 + 2 THEN 'p_brand+p_type' WHEN n2 >= 15 THEN 'p_brand' ELSE 'unavailable' END AS rung,
  CASE WHEN n0 >= 15 THEN n0 WHEN n1 >= 15 THEN n1 WHEN n2 >= 15 THEN n2 ELSE 0 END AS n_peers FROM c""")
def peer_ladder(t: Tables):
    rows = t.part.select("p_partkey", "p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("sz"), (F.col("p_partkey") % 40).alias("own"))
    return M.ladder(rows, rows, [["p_brand", "p_type", "sz"], ["p_brand", "p_type"], ["p_brand"]], "p_partkey", "own", floor=15)


@query("dom09_peer_curves", """
SELECT p_brand, p_size, count(*) AS n, CASE WHEN count(*) >= 2 THEN quantile_cont(c, 0.5) END AS p50, CASE WHEN count(*) >= 2 THEN 'available' ELSE 'insufficient' END AS status
FROM (SELECT p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT)::DOUBLE AS c FROM part) GROUP BY 1, 2""")
def dom09_peer_curves(t: Tables):
    rows = t.part.select("p_brand", "p_size", cents("p_retailprice").cast("double").alias("c"))
    return M.peer_curves(rows, ["p_brand"], "p_size", "c", floor=2).select("p_brand", "p_size", "n", "p50", "status")


@query("dom10_visible", "SELECT count(CASE WHEN l_shipdate <= TIMESTAMP '1996-01-01' THEN 1 END) AS seen, count(*) AS n FROM lineitem")
def dom10_visible(t: Tables):
    return t.lineitem.agg(F.count(M.visible("l_quantity", "l_shipdate", F.lit("1996-01-01").cast("timestamp_ntz"))).alias("seen"), F.count("*").alias("n"))


@query("scl15_leakage_guard", """
SELECT CASE WHEN k IS NULL THEN 'unavailable' WHEN k > o_orderdate THEN 'leakage' ELSE 'observed' END AS state, count(*) AS n FROM (SELECT o_orderdate, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE min(l_shipdate) END AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderpriority) GROUP BY 1""")
def scl15_leakage_guard(t: Tables):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("k0"))
    rows = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("k", F.when(F.col("o_orderpriority") != "5-LOW", F.col("k0")))
    return rows.groupBy(M.guarded_feature("o_totalprice", "k", "o_orderdate")[1].alias("state")).agg(F.count("*").alias("n"))


@query("dom11_feature_snapshot", """
WITH a AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-01-01' GROUP BY 1),
n AS (SELECT n_nationkey, count(DISTINCT r) AS k, min(r) AS one FROM (SELECT n_nationkey, n_regionkey % 2 AS r FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_regionkey > 2) GROUP BY 1)
SELECT c_custkey, strftime(d, '%Y-%m-%d') AS anchor_day, CASE WHEN d IS NULL THEN 'no_anchor' ELSE 'anchored' END AS anchor_status, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'conflict' ELSE 'resolved' END AS alias_status
FROM customer LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN n ON n_nationkey = c_nationkey""")
def dom11_feature_snapshot(t: Tables):
    old = F.lit("1990-01-01").cast("date")
    aliases = t.nation.where("n_regionkey > 0").select("n_nationkey", (F.col("n_regionkey") % 2).alias("formation"), old.alias("effective_from"))
    aliases = aliases.union(t.nation.where("n_regionkey > 2").select("n_nationkey", F.lit(1), old)).withColumnRenamed("n_nationkey", "c_nationkey")
    anchors = t.orders.select(F.col("o_custkey").alias("c_custkey"), day("o_orderdate").alias("event_day"), day("o_orderdate").alias("available_on"))
    out = M.feature_snapshot(t.customer.select("c_custkey", "c_nationkey"), anchors, aliases, "c_custkey", raw="c_nationkey", as_of=F.lit("1996-01-01").cast("date"))
    return out.select("c_custkey", F.col("anchor_day").cast("string").alias("anchor_day"), "anchor_status", "alias_status")


@query("agg17_pool_status", """
WITH r AS (SELECT l_orderkey, CASE WHEN l_tax >= 0.08 THEN NULL ELSE l_returnflag END AS f, l_discount AS c FROM lineitem)
SELECT l_orderkey, CASE WHEN count(f) = 0 THEN 'alias_unavailable' WHEN count(f) < count(*) THEN 'pool_unavailable' WHEN count(*) FILTER (c >= 0.01) < count(*) THEN 'below_confidence' WHEN count(DISTINCT f) FILTER (c >= 0.01) > 1 THEN 'conflict' ELSE 'mapped' END AS status FROM r GROUP BY 1""")
def agg17_pool_status(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_tax") < 0.08, F.col("l_returnflag")).alias("f"), F.col("l_discount").alias("c"))
    return M.pool_status(rows, "l_orderkey", "f", "c", 0.01).select("l_orderkey", "status")


@query("producing_class", """
WITH a AS (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders), f AS (SELECT o_custkey, bool_or(o_totalprice > 200000) AS p FROM orders, a WHERE date_trunc('month', o_orderdate) > a.m - INTERVAL 12 MONTH GROUP BY 1)
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'unknown' WHEN p THEN 'producing' WHEN NOT p THEN 'not_producing' ELSE 'unknown' END AS class FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def producing_class(t: Tables):
    keys = t.customer.select("c_custkey", "c_nationkey")
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), day("o_orderdate").alias("d"), (F.col("o_totalprice") - 200000).alias("v"))
    return M.producing_class(keys, rows, "c_custkey", "d", "v", months=12, unknown=F.col("c_nationkey") == 3).select("c_custkey", "class")


@query("agg25_allocation_residuals", """
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS retired, count(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS n_retired FROM lineitem GROUP BY 1""")
def agg25_allocation_residuals(t: Tables):
    q = F.col("l_quantity").cast("long")
    done = F.col("l_linestatus") == "F"
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(q).alias("total"), F.coalesce(F.sum(F.when(done, q)), F.lit(0)).alias("retired"), F.count_distinct(F.when(done, F.col("l_suppkey"))).alias("n_retired"))


@query("dom20_due_jobs", """
SELECT o_custkey, strftime(last + 30, '%Y-%m-%d') AS next_due, last + 30 <= DATE '1998-08-01' AS due FROM (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1)""")
def dom20_due_jobs(t: Tables):
    jobs = t.orders.groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("last_success")).withColumns({"kind": F.lit("cadence"), "every_days": F.lit(30), "month_day": F.lit(1)})
    return scheduling.next_due(jobs, F.lit("1998-08-01").cast("date")).select("o_custkey", F.col("next_due").cast("string").alias("next_due"), "due")


@query("dom29_snapshot_behind", """
SELECT l_suppkey, count(DISTINCT date_trunc('month', l_shipdate)) FILTER (l_shipdate > TIMESTAMP '1998-06-01') AS later_months, max(l_shipdate) > TIMESTAMP '1998-06-01' AS behind FROM lineitem GROUP BY 1""")
def dom29_snapshot_behind(t: Tables):
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    late = F.when(F.col("l_shipdate") > cut, F.date_format("l_shipdate", "yyyy-MM"))
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct(late).alias("later_months"), (F.max("l_shipdate") > cut).alias("behind"))


@query("dom26_completion_anchor", """
SELECT l_orderkey, strftime(min(CAST(l_shipdate AS DATE)) FILTER (l_shipdate >= o_orderdate), '%Y-%m-%d') AS anchor, count(*) FILTER (l_shipdate < o_orderdate) AS reversed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def dom26_completion_anchor(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ok = F.col("l_shipdate") >= F.col("o_orderdate")
    return joined.groupBy("l_orderkey").agg(F.min(F.when(ok, day("l_shipdate"))).cast("string").alias("anchor"), F.count_if(~ok).alias("reversed"))


@query("dom27_membership", "SELECT l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n_groups FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <> 1)")
def dom27_membership(t: Tables):
    from oreline.operators.windows import overlap_count

    return overlap_count(t.lineitem.where("l_suppkey <> 1").select("l_suppkey", "l_partkey").distinct(), ["l_partkey"], "n_groups")


@query("dom18_resolver_refresh", """
SELECT 'status' AS domain, o_orderstatus AS code, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'flag', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def dom18_resolver_refresh(t: Tables):
    maps = [("status", t.orders, "o_orderstatus"), ("flag", t.lineitem, "l_returnflag")]
    frames = [df.groupBy(F.col(c).alias("code")).agg(F.count("*").alias("n")).select(F.lit(name).alias("domain"), "code", "n") for name, df, c in maps]
    return frames[0].unionByName(frames[1])


@query("agg03_gap_to_month", "SELECT o_orderkey, date_diff('month', o_orderdate, TIMESTAMP '1998-12-01') AS months FROM orders")
def agg03_gap_to_month(t: Tables):
    from oreline.functions.scalar import months_apart

    return t.orders.select("o_orderkey", months_apart(F.lit("1998-12-01").cast("date"), "o_orderdate").cast("long").alias("months"))

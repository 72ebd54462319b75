"""Two-clock reads, joins and paging on the star schema.

Line items play the facts (``l_shipdate`` is the vintage, ``l_returnflag`` the
stream), orders the entities, customers and suppliers the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oreline.functions import scalar as S
from oreline.operators import lineage, paging, rules, scheduling, serving, temporal
from oreline.plans.registry import Tables, cents, day, query, text_day

_TIE = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_LATEST = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS r
      FROM lineitem {where}) WHERE r = 1
"""


def _latest(t: Tables, as_of=None):
    head = temporal.latest(t.lineitem, ["l_orderkey", "l_linenumber"], "l_shipdate", _TIE, as_of=as_of)
    return head.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text_day("l_shipdate").alias("shipped"), cents("l_extendedprice").alias("cents"))


@query("latest_vintage", _LATEST.format(where=""))
def latest_vintage(t: Tables):
    return _latest(t)


@query("as_of_cut", _LATEST.format(where="WHERE l_shipdate <= TIMESTAMP '1998-01-01'"))
def as_of_cut(t: Tables):
    return _latest(t, F.lit("1998-01-01").cast("timestamp_ntz"))


@query("win02_effective_dimension", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def win02_effective_dimension(t: Tables):
    return temporal.latest(t.orders, ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("win03_distinct_on", """
SELECT DISTINCT ON (c_nationkey, c_mktsegment) c_nationkey, c_mktsegment, c_custkey, c_name FROM customer
ORDER BY c_nationkey, c_mktsegment, c_acctbal DESC, c_custkey""")
def win03_distinct_on(t: Tables):
    head = temporal.first_per_key(t.customer, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")])
    return head.select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")


@query("win04_registry_two_clocks", """
SELECT o_orderpriority AS code, p AS published FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, p DESC) AS r
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders) WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND p <= 25000000) WHERE r = 1""")
def win04_registry_two_clocks(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("code"), day("o_orderdate").alias("effective_from"), cents("o_totalprice").alias("published_at"))
    found = temporal.registry_as_of(rows, "code", F.lit(25000000), F.lit("1996-06-30").cast("date"))
    return found.select("code", F.col("published_at").alias("published"))


@query("jon01_available_facts", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, strftime(greatest(l.l_shipdate, o.o_orderdate), '%Y-%m-%d') AS available_on
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE greatest(l.l_shipdate, o.o_orderdate) <= TIMESTAMP '1995-06-30'""")
def jon01_available_facts(t: Tables):
    facts = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("l_shipdate", "report_vintage")
    manifests = t.orders.select("o_orderkey", F.col("o_orderdate").alias("fetch_vintage"))
    derivations = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("timestamp_ntz").alias("created_vintage"))
    known = temporal.available_facts(facts, manifests, derivations, F.lit("1995-06-30").cast("timestamp_ntz"), manifest_key="o_orderkey", derivation_key="o_custkey")
    return known.select("l_orderkey", "l_linenumber", "l_partkey", text_day("available_on").alias("available_on"))


@query("jon02_status_resolver", """
SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderstatus = 'F' THEN 'final' END, CASE WHEN o.o_orderstatus = 'O' THEN 'open' END, 'unresolved') AS resolved_status
FROM orders o""")
def jon02_status_resolver(t: Tables):
    resolver = t.spark.createDataFrame([("O", "open")], "o_orderstatus string, status string")
    promoted = t.orders.withColumn("promoted", F.when(F.col("o_orderstatus") == "F", "final"))
    return serving.resolved(promoted, F.broadcast(resolver), ["o_orderstatus"], "promoted", "unresolved").select("o_orderkey", "resolved_status")


@query("jon03_latest_per_outer_row", """
SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN LATERAL (
  SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def jon03_latest_per_outer_row(t: Tables):
    last = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("last.o_orderkey").alias("o_orderkey"))


@query("alias_asof_join", """
WITH price AS (SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS eff, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
asked AS (SELECT l_orderkey, l_linenumber, l_partkey, max(CAST(l_shipdate AS DATE)) AS at FROM lineitem GROUP BY ALL),
matched AS (SELECT a.*, p.cents, p.eff, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber, a.l_partkey ORDER BY p.eff DESC NULLS LAST) AS r
  FROM asked a LEFT JOIN price p ON p.l_partkey = a.l_partkey AND p.eff <= a.at)
SELECT l_orderkey, l_linenumber, l_partkey, cents, strftime(eff, '%Y-%m-%d') AS eff FROM matched WHERE r = 1""")
def alias_asof_join(t: Tables):
    price = t.lineitem.groupBy("l_partkey", F.trunc(day("l_shipdate"), "MM").alias("eff")).agg(F.max(cents("l_extendedprice")).alias("cents"))
    asked = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max(day("l_shipdate")).alias("at"))
    found = temporal.as_of_join(asked, price, ["l_partkey"], "at", "eff")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "cents", text_day("eff").alias("eff"))


for _per in (True, False):
    _name = "own" if _per else "global"

    @query(f"jon05_membership_{_name}", f"""
SELECT l_suppkey, l_partkey, strftime(eff, '%Y-%m-%d') AS eff FROM (
  SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS eff, max(CAST(l_shipdate AS DATE)) OVER ({'PARTITION BY l_suppkey' if _per else ''}) AS newest
  FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1997-01-01') WHERE eff = newest""")
    def _membership(t: Tables, per=_per):
        rows = t.lineitem.select("l_suppkey", "l_partkey", day("l_shipdate").alias("eff"))
        found = temporal.membership_as_of(rows, "l_suppkey", "eff", F.lit("1997-01-01").cast("date"), per_group=per)
        return found.select("l_suppkey", "l_partkey", text_day("eff").alias("eff"))


@query("jon06_effective_fan_out", """
SELECT DISTINCT o.o_orderkey, l.l_suppkey FROM orders o
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate <= o.o_orderdate""")
def jon06_effective_fan_out(t: Tables):
    left = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderdate")
    right = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("eff"), "l_suppkey")
    return temporal.effective_fan_out(left, right, ["k"], "o_orderdate", "eff", "l_suppkey").select(F.col("k").alias("o_orderkey"), "l_suppkey")


@query("jon09_fallback_union", """
SELECT c_custkey, 'order' AS via FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'account' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_acctbal > 0""")
def jon09_fallback_union(t: Tables):
    first = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("order").alias("via"))
    rest = t.customer.where("c_acctbal > 0").join(first.select("c_custkey"), "c_custkey", "left_anti").select("c_custkey", F.lit("account").alias("via"))
    return first.unionByName(rest)


@query("jon16_orphans", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def jon16_orphans(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("jon17_case_blind_link", "SELECT n_name, r_name FROM nation n JOIN region r ON lower(trim(r.r_name)) = lower(trim(' ' || r.r_name || ' ')) AND n.n_regionkey = r.r_regionkey")
def jon17_case_blind_link(t: Tables):
    child = t.region.select(F.concat(F.lit(" "), F.upper("r_name"), F.lit(" ")).alias("label"), F.col("r_regionkey").alias("k"))
    linked = t.region.join(child, F.lower(F.trim("r_name")) == F.lower(F.trim("label")))
    return t.nation.join(linked, F.col("n_regionkey") == F.col("k")).select("n_name", "r_name")


@query("jon18_derived_aggregate", """
SELECT o.o_orderkey, s.n, s.total FROM orders o JOIN (
  SELECT l_orderkey || '_' || l_linestatus AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1) s
ON s.k = o.o_orderkey || '_' || o.o_orderstatus""")
def jon18_derived_aggregate(t: Tables):
    stats = t.lineitem.groupBy(F.concat_ws("_", "l_orderkey", "l_linestatus").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return t.orders.join(stats, F.concat_ws("_", "o_orderkey", "o_orderstatus") == F.col("k")).select("o_orderkey", "n", "total")


@query("jon19_scalar_params", """
SELECT p.cut, count(*) FILTER (WHERE c_acctbal >= p.cut) AS n FROM customer CROSS JOIN (VALUES (0), (2500), (5000)) p(cut) GROUP BY p.cut""")
def jon19_scalar_params(t: Tables):
    params = F.explode(F.array(*[F.lit(c) for c in (0, 2500, 5000)])).alias("cut")
    return t.customer.select("c_acctbal", params).groupBy("cut").agg(F.count_if(F.col("c_acctbal") >= F.col("cut")).alias("n"))


@query("jon20_ordered_merge", """
SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def jon20_ordered_merge(t: Tables):
    sums = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
    return t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "cents")


@query("jon21_snapshot_edges", """
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b
ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey AND b.o_orderdate < a.o_orderdate""")
def jon21_snapshot_edges(t: Tables):
    side = lambda p: t.orders.select(F.col("o_orderkey").alias(p), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias(f"{p}_day"))
    return side("a").join(side("b"), ["o_custkey", "o_orderpriority"]).where("a <> b AND b_day < a_day").select("a", "b")


@query("jon22_values_lookup", """
SELECT m.stream, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN (VALUES ('A', 'adjusted'), ('N', 'new'), ('R', 'new')) m(flag, stream) ON flag = l_returnflag GROUP BY 1""")
def jon22_values_lookup(t: Tables):
    lookup = t.spark.createDataFrame([("A", "adjusted"), ("N", "new"), ("R", "new")], "l_returnflag string, stream string")
    # Three rows: sent to every task, as a shuffle would put each flag's lines into one.
    return t.lineitem.join(F.broadcast(lookup), "l_returnflag").groupBy("stream").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("agg33_vintage_bounds", "SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_vintage, strftime(max(l_shipdate), '%Y-%m-%d') AS last_vintage FROM lineitem GROUP BY 1")
def agg33_vintage_bounds(t: Tables):
    b = temporal.vintage_bounds(t.lineitem, "l_orderkey", "l_shipdate")
    return b.select("l_orderkey", text_day("first_vintage").alias("first_vintage"), text_day("last_vintage").alias("last_vintage"))


@query("dom17_rules_in_force", """
WITH rules AS (SELECT o_orderkey AS rule_id, CAST(o_orderdate AS DATE) AS eff, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey - 1 END AS sup, CAST(round(o_totalprice * 100) AS BIGINT) AS published FROM orders),
live AS (SELECT * FROM rules WHERE eff <= DATE '1996-01-01' AND published <= 25000000 AND eff + 400 > DATE '1996-01-01')
SELECT rule_id FROM live WHERE rule_id NOT IN (SELECT sup FROM live WHERE sup IS NOT NULL)""")
def dom17_rules_in_force(t: Tables):
    rules = t.orders.select(
        F.col("o_orderkey").alias("rule_id"), cents("o_totalprice").alias("published_vintage"), day("o_orderdate").alias("effective_from"),
        F.date_add(day("o_orderdate"), 400).alias("effective_to"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") - 1).alias("supersedes_rule_id"),
    )
    return temporal.rules_in_force(rules, F.lit(25000000), F.lit("1996-01-01").cast("date")).select("rule_id")


@query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 51")
def keyset_page(t: Tables):
    return paging.page(t.customer.select("c_custkey", "c_name"), ["c_custkey"], 50, [100])


@query("srt02_composite_keyset", "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE (n_regionkey, n_nationkey) > (1, 3) ORDER BY 1, 2 LIMIT 11")
def srt02_composite_keyset(t: Tables):
    return paging.page(t.nation.select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey", "n_nationkey"], 10, [1, 3])


@query("srt03_top_n", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 7")
def srt03_top_n(t: Tables):
    return paging.top_n(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "n", "p_brand", 7)


@query("srt04_nulls_last", """
SELECT c_custkey, (row_number() OVER (ORDER BY n ASC NULLS LAST, c_custkey))::INTEGER AS place FROM customer LEFT JOIN (SELECT o_custkey, nullif(count(*), 5) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
ORDER BY place LIMIT 100""")
def srt04_nulls_last(t: Tables):
    counts = t.orders.groupBy("o_custkey").agg(F.nullif(F.count("*"), F.lit(5)).alias("n"))
    first = t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.asc_nulls_last("n"), "c_custkey").limit(100)
    return first.select("c_custkey", F.row_number().over(Window.orderBy(F.asc_nulls_last("n"), "c_custkey")).alias("place"))  # a hundred rows


@query("srt05_capped_history", """
SELECT o_custkey, o_orderkey, greatest(n - 3, 0) AS older FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 3""")
def srt05_capped_history(t: Tables):
    from oreline.operators.windows import capped_history

    return capped_history(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "older")


@query("prj19_dynamic_filters", """
SELECT c_custkey FROM customer c WHERE c_mktsegment ILIKE '%build%' AND c_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000)""")
def prj19_dynamic_filters(t: Tables):
    busy = t.orders.where("o_totalprice > 1000").select(F.col("o_custkey").alias("c_custkey"))
    preds = [S.contains_text("c_mktsegment", "build"), F.col("c_nationkey").isin(*range(1, 9)), None]
    return serving.filtered(t.customer, preds, [(busy, ["c_custkey"])]).select("c_custkey")


@query("prj20_scope_set", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def prj20_scope_set(t: Tables):
    names = serving.scope_set(["r1,r3", "R1"], {"R0", "R1", "R2", "R3", "R4"})
    return t.nation.where(F.concat(F.lit("R"), "n_regionkey").isin(names)).select("n_name")


@query("lineage_walk", """
WITH RECURSIVE edges AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders),
walk(root, node, depth) AS (
  SELECT o_orderkey, o_orderkey, 0 FROM orders
  UNION ALL SELECT w.root, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node WHERE w.depth < 8)
SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def lineage_walk(t: Tables):
    edges = t.orders.select(F.col("o_orderkey").alias("child"), F.floor(F.col("o_orderkey") / 2).alias("parent"))
    roots = t.orders.select("o_orderkey")
    return lineage.walk(edges, roots, "child", "parent", depth=8)


@query("src02_manifest_heads", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def src02_manifest_heads(t: Tables):
    m = t.orders.select(F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").alias("source_key"), F.col("o_orderdate").alias("fetch_vintage"), F.col("o_orderkey").alias("manifest_id"))
    return lineage.manifest_heads(m).select(F.col("source_key").alias("o_custkey"), F.col("manifest_id").alias("o_orderkey"))


@query("dom25_glossary_index", """
SELECT DISTINCT p_type AS term, form, len(string_split(form, ' '))::INTEGER AS words FROM (SELECT p_type, unnest([p_type, split_part(p_type, ' ', 1)]) AS form FROM part)""")
def dom25_glossary_index(t: Tables):
    terms = t.part.select(F.col("p_type").alias("term"), F.array(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("aliases")).distinct()
    return serving.glossary_index(terms, "term", "aliases").select("term", "form", "words")


@query("dom24_selector_proof", """
SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) = 1 AS exactly_one, count(o_orderkey) > 0 AS any_row FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def dom24_selector_proof(t: Tables):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lineage.selector_matches(t.customer.select("c_custkey"), done, ["c_custkey"]).select("c_custkey", "n", "exactly_one", "any_row")


@query("src02_supersession_chain", """
WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS head FROM orders)
SELECT * FROM o""")
def src02_supersession_chain(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    chain = t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("supersedes"))
    return lineage.supersession_chain(chain, key="o_orderkey", supersedes="supersedes")


@query("prj23_per_thousand", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 900 >= 300 THEN l_quantity::DOUBLE / ((l_partkey % 900) / 1000) END AS per_thousand FROM lineitem""")
def prj23_per_thousand(t: Tables):
    length = (F.col("l_partkey") % 900).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", serving.per_thousand(F.col("l_quantity").cast("double"), length, 300.0).alias("per_thousand"))


@query("dom20_jobs_after_jobs", """
WITH j AS (SELECT o_custkey AS job, max(CAST(o_orderdate AS DATE)) AS ran FROM orders GROUP BY 1)
SELECT j.job, strftime(CASE WHEN p.ran > j.ran THEN p.ran END, '%Y-%m-%d') AS next_due, coalesce(p.ran > j.ran AND p.ran <= DATE '1998-08-01', false) AS due FROM j LEFT JOIN j p ON p.job = j.job + 3""")
def dom20_jobs_after_jobs(t: Tables):
    jobs = t.orders.groupBy(F.col("o_custkey").alias("job")).agg(F.max(day("o_orderdate")).alias("last_success"))
    jobs = jobs.withColumns({"kind": F.lit("after"), "every_days": F.lit(None).cast("int"), "month_day": F.lit(None).cast("int"), "after_job": F.col("job") + 3})
    return scheduling.next_due(jobs, F.lit("1998-08-01").cast("date")).select("job", F.col("next_due").cast("string").alias("next_due"), "due")


#: A shift grid over the customers' points, bilinear in its steps, and rules that use it and an alias table.
@query("prj09_datum_grid", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 50 <> 7 THEN -105.0 + (c_custkey % 97) / 16.0 END AS lon, 40.0 + (c_custkey % 89) / 32.0 AS lat, c_nationkey FROM customer),
s AS (SELECT *, lon + 105 AS u, lat - 40 AS v FROM p)
SELECT c_custkey, CASE WHEN u < 5 THEN CAST(round((lon + (3 * u + v + u * v) / 1e5) * 1e8) AS BIGINT) END AS x, CASE WHEN u < 5 THEN CAST(round((lat + (u - 2 * v) / 1e5) * 1e8) AS BIGINT) ELSE CAST(round(lat * 0) AS BIGINT) END AS y,
  n_name AS alias, u >= 5 AS rejected FROM s JOIN nation ON n_nationkey = c_nationkey WHERE u IS NOT NULL""")
def prj09_datum_grid(t: Tables):
    k = F.col("c_custkey")
    points = t.customer.select(k, F.when(k % 50 != 7, F.lit(-105.0) + (k % 97) / 16.0).alias("lon"), (F.lit(40.0) + (k % 89) / 32.0).alias("lat"), "c_nationkey")
    i, j = k % 6, F.floor(k / 6) % 5
    grid = t.customer.select((i - 105).alias("gx"), (j + 40).alias("gy"), ((3 * i + j + i * j) / 1e5).alias("dx"), ((i - 2 * j) / 1e5).alias("dy")).distinct()
    aliases = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("alias"), F.lit(0.9).alias("confidence"))
    rules_ = [
        rules.Rule("datum", "datum_transform", {"frame": "grid", "x": "lon", "y": "lat", "source": "NAD27", "target": "WGS84", "step": 1.0}),
        rules.Rule("names", "alias_join", {"frame": "aliases", "keys": ["c_nationkey"], "value": "alias", "min_confidence": 0.5}),
    ]
    kept, (lost, _) = rules.apply_rules(points, rules_, {"grid": grid, "aliases": aliases})
    whole = lambda c: F.round(F.col(c) * 1e8).cast("long")
    moved = kept.where("lon IS NOT NULL").select("c_custkey", whole("lon").alias("x"), whole("lat").alias("y"), "alias", F.lit(False).alias("rejected"))
    rest = lost.join(aliases, "c_nationkey").select("c_custkey", F.lit(None).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "alias", F.lit(True).alias("rejected"))
    return moved.union(rest)

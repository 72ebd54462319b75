"""Rule executors, append-only batches and scalar facts on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oreline.functions import scalar as S
from oreline.operators import aggregates, append, rules, serving
from oreline.plans.registry import Tables, cents, day, query, text_day
from oreline.sources import sinks
from oreline.storage import shared_root

# Batches: line items first shipped by September are on record (A); a later run reads those from April on (B).
_BATCHES = """
WITH base AS (SELECT l_orderkey, l_linenumber, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, min(l_suppkey) AS supp,
  max(CAST(round(l_discount * 100) AS BIGINT)) AS d, min(CAST(round(l_tax * 100) AS BIGINT)) AS x, month(min(l_shipdate)) AS m FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_orderkey, l_linenumber, CASE WHEN d < 9 THEN cents END AS cents, supp FROM base WHERE m <= 9),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN x <= 1 THEN cents + 1 WHEN d < 10 THEN cents END AS cents, supp FROM base WHERE m >= 4)
"""


def _batches(t: Tables):
    base = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(cents("l_extendedprice")).alias("cents"), F.min("l_suppkey").alias("supp"),
        F.max(cents("l_discount")).alias("d"), F.min(cents("l_tax")).alias("x"), F.month(F.min("l_shipdate")).alias("m"),
    )
    a = base.where("m <= 9").withColumn("cents", F.when(F.col("d") < 9, F.col("cents")))
    b = base.where("m >= 4").withColumn("cents", F.when(F.col("x") <= 1, F.col("cents") + 1).when(F.col("d") < 10, F.col("cents")))
    return a.drop("d", "x", "m"), b.drop("d", "x", "m")


@query("change_only_append", _BATCHES + """
SELECT b.l_orderkey, b.l_linenumber, b.cents FROM b LEFT JOIN a USING (l_orderkey, l_linenumber) WHERE a.l_orderkey IS NULL OR a.cents IS DISTINCT FROM b.cents""")
def change_only_append(t: Tables):
    a, b = _batches(t)
    return append.changed_only(b, a, ["l_orderkey", "l_linenumber"], "cents").select("l_orderkey", "l_linenumber", "cents")


@query("jon12_unseen_only", _BATCHES + "SELECT b.l_orderkey, b.l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)")
def jon12_unseen_only(t: Tables):
    a, b = _batches(t)
    return append.unseen_only(b, a, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("divergence", _BATCHES + """
SELECT b.l_orderkey, b.l_linenumber FROM b JOIN a USING (l_orderkey, l_linenumber) WHERE (a.cents, a.supp) IS DISTINCT FROM (b.cents, b.supp)""")
def divergence(t: Tables):
    a, b = _batches(t)
    return append.diverged(b, a, ["l_orderkey", "l_linenumber"], ["cents", "supp"]).select("l_orderkey", "l_linenumber")


@query("withdrawn", _BATCHES + "SELECT a.l_orderkey, a.l_linenumber FROM a LEFT JOIN b USING (l_orderkey, l_linenumber) WHERE b.l_orderkey IS NULL")
def withdrawn(t: Tables):
    a, b = _batches(t)
    return append.withdrawn(a, b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("jon15_changed_keys", """
WITH s AS (SELECT l_orderkey, l_shipdate < TIMESTAMP '1995-01-01' AS old, count(*) AS n, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS sig FROM lineitem GROUP BY 1, 2)
SELECT n.l_orderkey FROM s n LEFT JOIN s o ON o.old AND o.l_orderkey = n.l_orderkey WHERE NOT n.old AND (o.l_orderkey IS NULL OR o.n <> n.n OR o.sig <> n.sig)""")
def jon15_changed_keys(t: Tables):
    old = t.lineitem.where("l_shipdate < timestamp_ntz '1995-01-01'")
    new = t.lineitem.where("l_shipdate >= timestamp_ntz '1995-01-01'")
    return append.changed_keys(new, old, ["l_orderkey"], "l_suppkey")


@query("collision_router", """
SELECT route, count(*) AS n FROM (
  SELECT CASE WHEN min(p) OVER w <> max(p) OVER w THEN 'collision' WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, p, l_partkey, l_suppkey) = 1 THEN 'kept' ELSE 'duplicate' END AS route
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) GROUP BY 1""")
def collision_router(t: Tables):
    order = [F.asc(c) for c in ("l_shipdate", "cents", "l_partkey", "l_suppkey")]
    return append.route_collisions(t.lineitem.withColumn("cents", cents("l_extendedprice")), ["l_orderkey", "l_linenumber"], "cents", order).groupBy("route").agg(F.count("*").alias("n"))


@query("win06_occurrence_rank", """
SELECT occurrence::INTEGER AS occurrence, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS occurrence FROM lineitem) GROUP BY 1""")
def win06_occurrence_rank(t: Tables):
    return append.occurrence(t.lineitem, ["l_orderkey", "l_linenumber"], [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey")]).groupBy("occurrence").agg(F.count("*").alias("n"))


@query("dom14_bitemporal_append", """
WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
store AS (SELECT * FROM v WHERE d < DATE '1996-01-01'), head AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM store ORDER BY l_orderkey, l_linenumber, d DESC),
batch AS (SELECT * FROM v WHERE d >= DATE '1996-01-01')
SELECT b.l_orderkey, b.l_linenumber, strftime(b.d, '%Y-%m-%d') AS vintage, b.q FROM batch b LEFT JOIN head h USING (l_orderkey, l_linenumber) WHERE h.q IS NULL OR h.q <> b.q""")
def dom14_bitemporal_append(t: Tables):
    v = t.lineitem.groupBy("l_orderkey", "l_linenumber", day("l_shipdate").alias("d")).agg(F.max(F.col("l_quantity").cast("long")).alias("q"))
    cut = F.lit("1996-01-01").cast("date")
    added = append.bitemporal_append(v.where(F.col("d") < cut), v.where(F.col("d") >= cut), ["l_orderkey", "l_linenumber"], "d", "q")
    return added.select("l_orderkey", "l_linenumber", text_day("d").alias("vintage"), "q")


@query("dom15_quarantine_ledger", """
SELECT l_linestatus AS reason_code, sum(n)::BIGINT AS seen, count(*) AS fingerprints, max(n) AS most FROM (
  SELECT l_linestatus, l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY 1, 2) GROUP BY 1""")
def dom15_quarantine_ledger(t: Tables):
    bad = t.lineitem.where("l_quantity < 3").select("l_suppkey", F.col("l_linestatus").alias("reason_code"), F.lit("r1").alias("rule_id"), "l_shipdate")
    rows = append.quarantine_rows(bad.drop("l_shipdate"), "lineitem", "validate", F.lit("2024-01-01").cast("date"))
    ledger = append.quarantine_ledger(rows)
    return ledger.groupBy("reason_code").agg(F.sum("occurrence_count").alias("seen"), F.count("*").alias("fingerprints"), F.max("occurrence_count").alias("most"))


@query("dom16_open_as_of", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR CAST(o_orderdate AS DATE) > DATE '1997-06-01'")
def dom16_open_as_of(t: Tables):
    ledger = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("released").alias("state"), day("o_orderdate").alias("released_at_vintage"))
    return append.open_as_of(ledger, F.lit("1997-06-01").cast("date")).select("o_orderkey")


@query("dom23_unreferenced", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dom23_unreferenced(t: Tables):
    refs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return append.unreferenced(t.orders, refs, "o_orderkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("dom28_restated_points", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dom28_restated_points(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("dom30_revisions", """
WITH head AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderpriority DESC)
SELECT o_custkey, c_mktsegment AS o_orderpriority FROM head JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS DISTINCT FROM o_orderpriority""")
def dom30_revisions(t: Tables):
    store = t.orders.select("o_custkey", day("o_orderdate").alias("effective_from"), "o_orderpriority")
    updates = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"))
    moved = append.revisions(store, updates, "o_custkey", "effective_from", ["o_orderpriority"], F.lit("2030-01-01").cast("date"))
    return moved.select("o_custkey", "o_orderpriority")


_RULE = {"op": "and", "args": [
    {"op": "between", "arg": {"col": "l_quantity"}, "low": {"lit": 5}, "high": {"lit": 40}},
    {"op": "or", "args": [{"op": "in", "arg": {"col": "l_returnflag"}, "values": [{"lit": "A"}, {"lit": "R"}]}, {"op": "cmp", "cmp": "gt", "left": {"col": "l_discount"}, "right": {"lit": 0.05}}]},
    {"op": "not", "arg": {"op": "is_null", "arg": {"col": "l_shipdate"}}}]}


@query("validity_filter", """
SELECT CASE WHEN l_quantity BETWEEN 5 AND 40 AND (l_returnflag IN ('A', 'R') OR l_discount > 0.05) AND l_shipdate IS NOT NULL THEN 'kept' ELSE 'rejected' END AS side, count(*) AS n FROM lineitem GROUP BY 1""")
def validity_filter(t: Tables):
    kept, rejected = rules.validity_filter(t.lineitem, rules.Rule("v1", "validity_filter", {"where": _RULE}))
    return kept.select(F.lit("kept").alias("side")).union(rejected.select(F.lit("rejected").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("vocab_map_quarantine", """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'kept' ELSE 'unmapped_code' END AS side,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' WHEN '5-LOW' THEN 'later' END AS code, count(*) AS n FROM orders GROUP BY 1, 2""")
def vocab_map_quarantine(t: Tables):
    rule = rules.Rule("m1", "vocab_map", {"column": "o_orderpriority", "into": "code", "map": [["1-URGENT", "now"], ["2-HIGH", "soon"], ["5-LOW", "later"]]})
    kept, rejected = rules.vocab_map(t.orders, rule)
    both = kept.select(F.lit("kept").alias("side"), "code").union(rejected.select(F.col("reason_code").alias("side"), "code"))
    return both.groupBy("side", "code").agg(F.count("*").alias("n"))


@query("prj05_alias_join", """
SELECT c_custkey, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey / 25.0 >= 0.2""")
def prj05_alias_join(t: Tables):
    aliases = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", (F.col("n_nationkey") / 25.0).alias("confidence"))
    rule = rules.Rule("a1", "alias_join", {"keys": ["c_nationkey"], "value": "r_name", "min_confidence": 0.2})
    return rules.alias_join(t.customer, rule, aliases)[0].select("c_custkey", "r_name")


@query("prj06_unit_conform", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CAST(l_quantity AS DECIMAL(18,3)) * 0.158987, 2) * 100 AS BIGINT) AS hundredths FROM lineitem""")
def prj06_unit_conform(t: Tables):
    rows = t.lineitem.withColumn("v", F.col("l_quantity").cast("decimal(18,3)"))
    out = rules.unit_conform(rows, rules.Rule("u1", "unit_conform", {"column": "v", "factor": "0.158987", "scale": 2}))[0]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("v") * 100).cast("long").alias("hundredths"))


@query("composite_key", """
SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) <= 3 THEN lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 3, '0') END AS entity_key FROM customer""")
def composite_key(t: Tables):
    rule = rules.Rule("k1", "key_composite", {"into": "entity_key", "parts": [["c_nationkey", 2], ["c_custkey", 3]]})
    kept, rejected = rules.key_composite(t.customer, rule)
    return kept.select("c_custkey", "entity_key").union(rejected.select("c_custkey", "entity_key"))


@query("prj01_rule_pipeline", """
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
WHERE l_quantity BETWEEN 5 AND 40 AND (l_returnflag IN ('A', 'R') OR l_discount > 0.05) AND l_returnflag IN ('A', 'N') GROUP BY 1""")
def prj01_rule_pipeline(t: Tables):
    chain = [
        rules.Rule("v1", "validity_filter", {"where": _RULE}),
        rules.Rule("p1", "code_ref"),
        rules.Rule("m1", "vocab_map", {"column": "l_returnflag", "into": "stream", "map": [["A", "adj"], ["N", "new"]]}),
    ]
    kept, _ = rules.apply_rules(t.lineitem, chain)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("prj16_bounded_fields", """
SELECT 'l_quantity' AS field, count(*) AS n FROM lineitem WHERE l_quantity > 45 OR l_quantity < 2
UNION ALL SELECT 'l_tax', count(*) FROM lineitem WHERE l_tax > l_discount""")
def prj16_bounded_fields(t: Tables):
    rule = rules.Rule("b1", "bounded", {"bounds": [{"column": "l_quantity", "min": 2, "max": 45}, {"column": "l_tax", "max_column": "l_discount"}]})
    _, rejected = rules.bounded_fields(t.lineitem, rule, ["l_orderkey"])
    return rejected.groupBy("field").agg(F.count("*").alias("n"))


@query("prj27_read_or_reject", """
WITH s AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT CASE WHEN TRY_CAST(k AS BIGINT) > 80 THEN 'implausible' ELSE 'read' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def prj27_read_or_reject(t: Tables):
    text = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    typed, rejected = rules.read_or_reject(text, ["event_id"], {"k": ("bigint", 80)})
    outcome = typed.join(rejected.select("event_id", "reason_code"), "event_id", "left").select(F.coalesce("reason_code", F.lit("read")).alias("outcome"))
    return outcome.groupBy("outcome").agg(F.count("*").alias("n"))


@query("prj31_first_failing", """
SELECT coalesce(CASE WHEN NOT (l_quantity > 3) THEN 'quantity' WHEN NOT (l_discount < 0.09) THEN 'discount' WHEN NOT (l_returnflag <> 'N') THEN 'flag' END, 'ok') AS verdict, count(*) AS n FROM lineitem GROUP BY 1""")
def prj31_first_failing(t: Tables):
    verdict = rules.first_failing([("quantity", F.col("l_quantity") > 3), ("discount", F.col("l_discount") < 0.09), ("flag", F.col("l_returnflag") != "N")])
    return t.lineitem.groupBy(F.coalesce(verdict, F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


@query("prj11_absent_if_blank", "SELECT o_orderstatus, nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '') AS kept, count(*) AS n FROM orders GROUP BY 1, 2")
def prj11_absent_if_blank(t: Tables):
    blanked = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return t.orders.groupBy("o_orderstatus", S.absent_if_blank(blanked).alias("kept")).agg(F.count("*").alias("n"))


@query("prj12_identity_key", """
SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) = 4 THEN substr(c_custkey::VARCHAR, 1, 3) END AS prefix FROM customer""")
def prj12_identity_key(t: Tables):
    dashed = F.regexp_replace(F.col("c_custkey").cast("string"), "^(.)", "$1-")
    return t.customer.select("c_custkey", S.identity_key(dashed, 4, 0, 3).alias("prefix"))


@query("prj13_typed_projection", """
SELECT c_custkey, TRY_CAST(substr(c_name, 1, 8) AS INTEGER) AS bad, TRY_CAST(split_part(c_name, '#', 2) AS INTEGER) AS number FROM customer""")
def prj13_typed_projection(t: Tables):
    return t.customer.select("c_custkey", F.substring("c_name", 1, 8).try_cast("int").alias("bad"), F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("int").alias("number"))


@query("stream_unpivot", """
SELECT l_returnflag, stream, CAST(sum(v) AS BIGINT) AS v FROM (
  SELECT l_returnflag, 'quantity' AS stream, CAST(l_quantity AS BIGINT) AS v FROM lineitem UNION ALL SELECT l_returnflag, 'price', CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT l_returnflag, 'discount', CAST(round(l_discount * 100) AS BIGINT) FROM lineitem) GROUP BY 1, 2""")
def stream_unpivot(t: Tables):
    wide = t.lineitem.select("l_returnflag", F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("price"), cents("l_discount").alias("discount"))
    return wide.unpivot(["l_returnflag"], ["quantity", "price", "discount"], "stream", "v").groupBy("l_returnflag", "stream").agg(F.sum("v").alias("v"))


@query("prj15_null_facts", """
SELECT CASE WHEN v IS NULL THEN CASE WHEN l_returnflag = 'R' THEN 'withheld' ELSE 'no_report' END WHEN v = 0 THEN 'reported_zero' ELSE 'reported' END AS fact, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_discount > 0.07 THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) END AS v FROM lineitem) GROUP BY 1""")
def prj15_null_facts(t: Tables):
    v = F.when(F.col("l_discount") <= 0.07, cents("l_discount"))
    return t.lineitem.groupBy(S.null_fact(v, F.col("l_returnflag") == "R").alias("fact")).agg(F.count("*").alias("n"))


@query("prj17_plausible_days", "SELECT count(*) FILTER (WHERE l_quantity <= day(last_day(l_shipdate))) AS kept, count(*) AS n FROM lineitem")
def prj17_plausible_days(t: Tables):
    return t.lineitem.agg(F.count(S.plausible_days("l_quantity", day("l_shipdate"))).alias("kept"), F.count("*").alias("n"))


@query("prj18_coordinate_fact", """
SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'coordinate_absent' WHEN x = 0 AND y = 0 THEN 'coordinate_sentinel' ELSE 'promote' END AS fact, count(*) AS n
FROM (SELECT nullif(l_discount, 0.05) AS x, round(l_tax, 2) AS y FROM lineitem) GROUP BY 1""")
def prj18_coordinate_fact(t: Tables):
    return t.lineitem.groupBy(S.coordinate_fact(F.nullif("l_discount", F.lit(0.05)), F.round("l_tax", 2)).alias("fact")).agg(F.count("*").alias("n"))


@query("prj21_length_bands", """
SELECT CASE WHEN p_size < 10 THEN 'under_10' WHEN p_size < 20 THEN '10_to_20' WHEN p_size <= 35 THEN '20_to_35' ELSE 'over_35' END AS band, count(*) AS n FROM part GROUP BY 1""")
def prj21_length_bands(t: Tables):
    return t.part.groupBy(S.length_band("p_size", (10, 20), 35).alias("band")).agg(F.count("*").alias("n"))


@query("prj22_ratio_or_reason", """
SELECT coalesce(CASE WHEN p_size IS NULL THEN 'length_unavailable' WHEN p_size <= 0 THEN 'length_implausible' WHEN c / p_size < 3000 OR c / p_size > 90000 THEN 'out_of_range' END, 'ok') AS reason, count(*) AS n
FROM (SELECT CASE WHEN p_size > 45 THEN NULL WHEN p_size < 4 THEN 0 ELSE p_size END AS p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) GROUP BY 1""")
def prj22_ratio_or_reason(t: Tables):
    size = F.when(F.col("p_size") > 45, None).when(F.col("p_size") < 4, 0).otherwise(F.col("p_size"))
    rows = t.part.select(size.alias("s"), cents("p_retailprice").alias("c"))
    _, reason = S.ratio_or_reason("c", "s", F.lit("reported"), 3000, 90000)
    return rows.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("prj24_basin_membership", """
SELECT CASE WHEN n_nationkey = 7 THEN 'no_geometry' WHEN n_regionkey < 3 THEN 'in_published_boundary' ELSE 'outside' END AS place,
  CASE WHEN n_nationkey = 5 THEN 'no_label' WHEN n_regionkey = 4 THEN 'not_labelled' WHEN lower(n_name) = lower(r_name) THEN 'agree' ELSE 'disagree' END AS label, count(*) AS n
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def prj24_basin_membership(t: Tables):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.when(F.col("n_nationkey") != 5, F.col("n_name"))
    name = F.when(F.col("n_regionkey") != 4, F.col("r_name"))
    place, match = serving.basin_membership(F.col("n_regionkey") < 3, F.col("n_nationkey") != 7, label, name)
    return joined.groupBy(place.alias("place"), match.alias("label")).agg(F.count("*").alias("n"))


@query("prj25_month_parsing", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders""")
def prj25_month_parsing(t: Tables):
    d = day("o_orderdate")
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    text = F.when(F.col("o_orderstatus") == "F", serial).when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyyMM")).otherwise(d.cast("string"))
    return t.orders.select("o_orderkey", S.month_of(text).cast("string").alias("month"))


@query("prj30_status_precedence", """
SELECT CASE WHEN length(trim(plug)) > 0 THEN 'plugged' ELSE nullif(trim(o_orderstatus), '') END AS status, count(*) AS n
FROM (SELECT o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN '1999' ELSE ' ' END AS plug FROM orders) GROUP BY 1""")
def prj30_status_precedence(t: Tables):
    plug = F.when(F.col("o_orderpriority") == "5-LOW", "1999").otherwise(" ")
    return t.orders.groupBy(serving.status_precedence(F.col("o_orderstatus"), plug, "plugged").alias("status")).agg(F.count("*").alias("n"))


@query("scl01_slug", "SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def scl01_slug(t: Tables):
    return t.part.select("p_type", S.slug("p_type").alias("slug")).distinct()


@query("scl04_half_year", "SELECT year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-h1' ELSE '-h2' END AS half, count(*) AS n FROM orders GROUP BY 1")
def scl04_half_year(t: Tables):
    return t.orders.groupBy(S.half_year("o_orderdate").alias("half")).agg(F.count("*").alias("n"))


@query("scl07_row_digest", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS digest FROM nation")
def scl07_row_digest(t: Tables):
    return t.nation.select("n_nationkey", S.canonical_digest("n_regionkey", "n_name").alias("digest"))


@query("scl08_json_build", """
SELECT r_name, to_json(list({'k': n_nationkey, 'n': n_name} ORDER BY n_nationkey))::VARCHAR AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def scl08_json_build(t: Tables):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.to_json(rows).alias("members"))


@query("scl11_selector_terms", "SELECT o_orderkey, o_custkey::VARCHAR AS cust, o_orderstatus AS status FROM orders")
def scl11_selector_terms(t: Tables):
    terms = S.selector_terms(F.concat(F.lit("cust="), "o_custkey", F.lit("&status="), "o_orderstatus"))
    return t.orders.select("o_orderkey", terms["cust"].alias("cust"), terms["status"].alias("status"))


@query("scl14_verdicts", """
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 10 THEN 'insufficient' WHEN l_tax - 0.06 < 0 THEN 'first_better' WHEN l_tax - 0.07 > 0 THEN 'second_better' ELSE 'tie' END AS verdict FROM lineitem) GROUP BY 1""")
def scl14_verdicts(t: Tables):
    n = F.when(F.col("l_quantity") < 10, 10).otherwise(60)
    rows = t.lineitem.select((F.col("l_tax") - 0.07).alias("lo"), (F.col("l_tax") - 0.06).alias("hi"), n.alias("n"))
    return rows.groupBy(S.outer_verdict("lo", "hi", "n").alias("verdict")).agg(F.count("*").alias("n"))


@query("scl16_freshness", """
WITH s AS (SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CASE WHEN last IS NULL THEN 'never_fetched' WHEN DATE '1998-09-01' - last > 360 THEN 'stale' WHEN DATE '1998-09-01' - last > 180 THEN 'due' ELSE 'fresh' END AS state, count(*) AS n FROM s GROUP BY 1""")
def scl16_freshness(t: Tables):
    last = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.max(day("o_orderdate")).alias("last"))
    return last.groupBy(S.freshness(F.col("last"), F.lit("1998-09-01").cast("date"), F.lit(180)).alias("state")).agg(F.count("*").alias("n"))


@query("prj28_trimmed_right", "SELECT o_orderkey, nullif(rtrim('  ' || o_orderpriority || repeat(' ', (o_orderkey % 4)::INTEGER), ' '), '') AS t FROM orders")
def prj28_trimmed_right(t: Tables):
    padded = F.concat(F.lit("  "), "o_orderpriority", F.repeat(F.lit(" "), (F.col("o_orderkey") % 4).cast("int")))
    return t.orders.select("o_orderkey", S.trimmed_right(padded).alias("t"))


@query("prj26_point_facts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'multi_pool_pending' WHEN o_orderkey % 5 = 0 THEN 'lease_reported' WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'reported' ELSE 'reported_zero' END AS fact
FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'multi_pool_pending' WHEN o_orderkey % 5 = 0 THEN 'lease_reported' ELSE 'no_report' END FROM orders WHERE o_orderkey % 3 = 0""")
def prj26_point_facts(t: Tables):
    k = F.col("o_orderkey")
    has = k % 3 != 0
    fact = F.when(has, F.when(k % 2 == 0, "reported").otherwise("reported_zero"))
    return t.orders.select("o_orderkey", serving.point_fact(has, fact, k % 7 == 0, k % 5 == 0).alias("fact"))


@query("prj08_header_policy", "SELECT 'contains' AS policy, count(*) AS kept, 0::BIGINT AS rejected FROM nation UNION ALL SELECT 'declared', 0, count(*) FROM nation")
def prj08_header_policy(t: Tables):
    """The nation file has more columns than are declared: enough for one policy, too many for the other."""
    out = []
    for policy in ("contains", "declared"):
        kept, rejected = rules.header_policy(t.nation, rules.Rule("h", "parse_directive", {"columns": ["n_nationkey", "n_name"], "policy": policy}))
        both = kept.select(F.lit(1).alias("k")).unionByName(rejected.select(F.lit(0).alias("k")))
        out.append(both.agg(F.lit(policy).alias("policy"), F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("rejected")))
    return out[0].unionByName(out[1])


@query("prj10_policy_rule_passes", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0")
def prj10_policy_rule_passes(t: Tables):
    test = {"op": "cmp", "cmp": "gt", "left": {"col": "r_regionkey"}, "right": {"lit": 0}}
    kept, _ = rules.apply_rules(t.region, [rules.Rule("p", "code_ref", {}), rules.Rule("v", "validity_filter", {"where": test})])
    return kept.select("r_regionkey", "r_name")


@query("dom22_replayed_build", "SELECT count(*) AS n, count(*) AS n_again, true AS same FROM (SELECT l_orderkey, sum(l_linenumber) FROM lineitem GROUP BY 1)")
def dom22_replayed_build(t: Tables):
    """Two builds of one mart, laid out differently, have the same logical digest."""
    build = lambda df: df.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("s"))
    digests = [aggregates.content_digest(build(df), ["l_orderkey", "s"]) for df in (t.lineitem, t.lineitem.repartition(5, "l_partkey"))]
    return digests[0].crossJoin(F.broadcast(digests[1].withColumnsRenamed({"n": "n_again", "digest": "again"}))).select("n", "n_again", (F.col("digest") == F.col("again")).alias("same"))  # one row each


@query("dom31_profile_mart", """
SELECT 'open' AS profile, o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'filled', o_orderkey, -CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderstatus = 'F'""")
def dom31_profile_mart(t: Tables):
    price = "CAST(round(o_totalprice * 100) AS BIGINT)"
    profiles = [
        sinks.Profile("open", "o_orderstatus = 'O'", {"key": "o_orderkey", "cents": price}),
        sinks.Profile("filled", "o_orderstatus = 'F'", {"key": "o_orderkey", "cents": f"-{price}"}),
    ]
    mart = sinks.rebuild_profiles(t.orders, profiles, f"{shared_root(t.spark)}/mart-{uuid.uuid4().hex}")
    return mart.select(F.col("profile").cast("string"), "key", "cents")


@query("dom32_reference_mart", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def dom32_reference_mart(t: Tables):
    path = f"{shared_root(t.spark)}/mart-{uuid.uuid4().hex}"
    for _ in range(2):  # a rebuild replaces the mart as a whole
        sinks.rebuild(t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name"), path)
    return t.spark.read.parquet(path)

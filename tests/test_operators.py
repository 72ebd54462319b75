"""Operators on small frames: the cases that the star-schema queries don't reach."""

import datetime as dt
import io
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from oreline import storage
from oreline.functions import scalar as S
from oreline.operators import aggregates, allocation, append, datum, geo, graph, lineage, modeling, paging, rules, scheduling, serving, temporal
from oreline.plans.catalog import QUERIES
from oreline.sources import files, sinks
from oreline.streaming import forms

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Scalars


@pytest.mark.parametrize("text,month", [("45292", "2024-01-01"), ("202402", "2024-02-01"), ("2024-03", "2024-03-01"), ("2024-04-30", "2024-04-01"), ("2024-05-09T10:00", "2024-05-01"), ("202413", None), ("x", None), ("", None), (None, None)])
def test_month_of(spark, text, month):
    got = one(spark, S.month_of(F.lit(text).cast("string")))
    assert (str(got) if got else None) == month


def test_rounding_modes(spark):
    for mode, want in (("half_up", -3), ("half_even", -2), ("down", -2)):
        assert float(one(spark, S.scaled(F.lit("-2.5"), "1", 0, mode))) == want
    with pytest.raises(ValueError):
        S.scaled(F.lit(1), "1", 0, "up")


def test_composite_key_never_cuts(spark):
    parts = lambda a, b: one(spark, S.composite_key([(F.lit(a).cast("string"), 2), (F.lit(b).cast("string"), 3)]))
    assert parts("7", "12") == "07012"
    assert parts("123", "1") is None and parts("", "1") is None and parts(None, "1") is None and parts("a", "1") is None


def test_selector_and_wildcards(spark):
    assert one(spark, S.selector_terms(F.lit("a=1&b=2"))) == {"a": "1", "b": "2"}
    assert one(spark, S.selector_terms(F.lit("a=1&&b"))) is None
    assert one(spark, S.selector_terms(F.lit("a=1&b=3&a=2"))) is None and one(spark, S.selector_terms(F.lit("a=1&aa=2"))) == {"a": "1", "aa": "2"}
    assert one(spark, S.contains_text(F.lit("50% off"), "0%")) and not one(spark, S.contains_text(F.lit("500"), "0%"))


def test_trim_keeps_leading_spaces(spark):
    assert one(spark, S.trimmed_right(F.lit(" a  "))) == " a" and one(spark, S.trimmed_right(F.lit("   "))) is None


# Rules


def test_predicate_nodes_and_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, y string")
    node = {"op": "not", "arg": {"op": "cmp", "cmp": "eq", "left": {"col": "x"}, "right": {"lit": 1}}}
    kept, rejected = rules.validity_filter(df, rules.Rule("r", "validity_filter", {"where": node, "reason_code": "bad"}))
    assert [r["x"] for r in kept.collect()] == [3]
    assert {r["reason_code"] for r in rejected.collect()} == {"bad"} and rejected.count() == 2  # unknown is not true
    for bad in ({"op": "and", "args": []}, {"op": "in", "arg": {"col": "x"}, "values": []}, {"op": "cmp", "cmp": "eq", "left": {"col": "x; drop"}, "right": {"lit": 1}}, {"op": "xor"}, {"op": "is_null", "arg": {"lit": [1]}}):
        with pytest.raises((ValueError, KeyError)):
            rules.predicate(bad)


def test_vocabulary_duplicates_and_passthrough(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(ValueError):
        rules.vocab_map(df, rules.Rule("m", "vocab_map", {"column": "c", "into": "d", "map": [["a", "1"], ["a", "2"]]}))
    kept, rejected = rules.vocab_map(df, rules.Rule("m", "vocab_map", {"column": "c", "into": "d", "map": [["a", "1"]]}, on_fail="passthrough"))
    assert sorted(map(tuple, kept.collect()), key=str) == [("a", "1"), ("z", None)] and rejected.count() == 0


def test_alias_ambiguity_is_refused(spark):
    df = spark.createDataFrame([("a",)], "k string")
    aliases = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.95), ("a", "w", 0.1)], "k string, v string, confidence double")
    with pytest.raises(ValueError):
        rules.alias_join(df, rules.Rule("a", "alias_join", {"keys": ["k"], "value": "v", "min_confidence": 0.5}), aliases)


def test_header_policy(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    contains, declared = ({"columns": ["a"], "policy": p} for p in ("contains", "declared"))
    assert rules.header_policy(df, rules.Rule("h", "parse_directive", contains))[0].count() == 1
    assert rules.header_policy(df, rules.Rule("h", "parse_directive", declared))[1].count() == 1


def test_bounded_fields_null_or_drop(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0), (2, 50.0, 9.0), (3, None, 9.0)], "k int, v double, m double")
    spec = {"bounds": [{"column": "v", "min": 1, "max": 10}, {"column": "m", "max_column": "v"}]}
    kept, rejected = rules.bounded_fields(df, rules.Rule("b", "bounded", spec), ["k"])
    assert kept.count() == 3 and {(r["k"], r["field"]) for r in rejected.collect()} == {(1, "m"), (2, "v")}
    dropped, _ = rules.bounded_fields(df, rules.Rule("b", "bounded", spec | {"action": "drop_row"}), ["k"])
    assert [r["k"] for r in dropped.collect()] == [3]


def test_rule_driver_order_and_unknown_kind(spark):
    df = spark.createDataFrame([("a",)], "c string")
    with pytest.raises(ValueError):
        rules.apply_rules(df, [rules.Rule("x", "mystery")])
    assert rules.apply_rules(df, [rules.Rule("p", "code_ref")])[0].count() == 1


# Append log


def test_append_refuses_divergence_and_is_idempotent(spark):
    schema = "k string, v date, x int"
    store = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("b", D(2024, 1, 1), None)], schema)
    batch = spark.createDataFrame([("a", D(2024, 2, 1), 1), ("b", D(2024, 2, 1), 5), ("c", D(2024, 2, 1), None)], schema)
    added = append.bitemporal_append(store, batch, ["k"], "v", "x")
    assert sorted(r["k"] for r in added.collect()) == ["b", "c"]
    assert append.bitemporal_append(store.union(added), batch, ["k"], "v", "x").count() == 0
    with pytest.raises(ValueError):
        append.bitemporal_append(store, spark.createDataFrame([("a", D(2024, 1, 1), 2)], schema), ["k"], "v", "x")


def test_collisions_promote_nothing(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1)], "k string, h int, o int")
    routes = {(r["k"], r["o"]): r["route"] for r in append.route_collisions(df, ["k"], "h", [F.asc("o")]).collect()}
    assert routes == {("a", 1): "kept", ("a", 2): "duplicate", ("b", 1): "collision", ("b", 2): "collision", ("c", 1): "kept"}


def test_ledger_counts_and_releases(spark):
    bad = spark.createDataFrame([("x", "r", "q")] * 3 + [("y", "r", "q")], "a string, reason_code string, rule_id string")
    seen = append.quarantine_rows(bad, "s", "validate", F.lit("2024-01-01").cast("date"))
    ledger = append.quarantine_ledger(seen)
    assert sorted(r["occurrence_count"] for r in ledger.collect()) == [1, 3]
    mark = ledger.where("occurrence_count = 3").select("row_fingerprint", F.lit("released").alias("state"), F.lit("2024-06-01").cast("date").alias("released_at_vintage"))
    after = append.quarantine_ledger(seen, mark)
    assert append.open_as_of(after, F.lit("2024-03-01").cast("date")).count() == 2
    assert append.open_as_of(after, F.lit("2024-07-01").cast("date")).count() == 1


def test_revision_at_or_past_the_date_aborts(spark):
    store = spark.createDataFrame([("a", D(2024, 5, 1), "x")], "k string, effective_from date, basin string")
    with pytest.raises(ValueError):
        append.revisions(store, spark.createDataFrame([("a", "y")], "k string, basin string"), "k", "effective_from", ["basin"], F.lit("2024-05-01").cast("date")).count()


def test_as_of_before_all_knowledge_is_refused(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),)], "v date")
    assert temporal.refuse_before_first(df, "v", D(2024, 2, 1)).count() == 1
    with pytest.raises(ValueError):
        temporal.refuse_before_first(df, "v", D(2023, 1, 1))


# Aggregates


def test_facets_add_up(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.choice(["a", "b", "c", "d", None]),) for _ in range(300)], "v string")
    rows = aggregates.facets(df, "v", top=2).collect()
    n = {k: sum(r["n"] for r in rows if r["kind"] == k) for k in ("value", "remainder", "null", "matched", "scope")}
    assert n["value"] + n["remainder"] == n["matched"] and n["matched"] + n["null"] == n["scope"] == 300


def test_percentile_conventions_differ_on_whole_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 101)], "g int, v int")
    near = aggregates.ranked_percentiles(df, ["g"], "v", {"p": (99, 100)}).first()["p"]
    floor = aggregates.ranked_percentiles(df, ["g"], "v", {"p": (99, 100)}, "floor").first()["p"]
    assert (near, floor) == (99, 100)


@pytest.mark.parametrize("seed,days", [(1, None), (2, None), (3, 5)])
def test_near_links_have_the_components_of_all_pairs(spark, seed, days):
    rnd = random.Random(seed)
    points = [(i, rnd.choice([0.0, 1.3, 2.2, 5.0]) + rnd.random() ** 3 * (0.2 if i % 2 else 2.0), rnd.random() * (0.1 if i % 3 else 3), rnd.randint(0, 30)) for i in range(260)]
    df = spark.createDataFrame([(i, x, y, dt.date(2024, 1, 1) + dt.timedelta(d)) for i, x, y, d in points] + [(999, None, 1.0, None)], "k long, x double, y double, d date")
    parent = {i: i for i, *_ in points}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x, y, d in points:
        for j, u, v, e in points[:i]:
            if math.hypot(x - u, y - v) <= 0.25 and (days is None or abs(d - e) <= days):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    links = geo.near_links(df, "k", "x", "y", 0.25, **({"day": "d", "days": days} if days else {}))
    found = {r["node"]: r["component"] for r in graph.connected_components(links, "a", "b").collect()}
    assert {i: found.get(i, i) for i, *_ in points} == {i: root(i) for i, *_ in points}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_over_slices(spark, keys):
    rnd = random.Random(5)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 4}", rnd.choice([None, 1, 2, 2, 5, rnd.randint(0, 400)])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"] if keys else None: r for r in aggregates.continuous_percentiles(df, keys, "v", {"p": 0.3, "q": 1.0}).collect()}
    for key in {g for g, _ in rows} if keys else [None]:
        values = sorted(v for g, v in rows if v is not None and (not keys or g == key))
        at = 0.3 * (len(values) - 1)
        low = values[int(at)]
        assert abs(got[key]["p"] - (low + (values[min(len(values) - 1, int(at) + 1)] - low) * (at - int(at)))) < 1e-9
        assert got[key]["q"] == values[-1] and got[key]["n"] == len(values)
    assert aggregates.continuous_percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_as_of_join_carries_the_best_row_forward(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 5, "x"), ("a", 0, "y"), (None, 9, "z"), ("b", None, "w")], "k string, at int, tag string")
    right = spark.createDataFrame([("a", 1, 2, "old"), ("a", 4, 1, "new"), ("a", 6, 9, "late"), (None, 1, 1, "none"), ("b", 1, 1, "b")], "k string, eff int, trust int, v string")
    plain = temporal.as_of_join(left, right, ["k"], "at", "eff")
    assert sorted((r["tag"], r["v"]) for r in plain.collect() if r["v"]) == [("x", "new"), ("x", "new")] and plain.count() == 5
    trusted = temporal.as_of_join(left, right, ["k"], "at", "eff", ["trust"])
    assert sorted((r["tag"], r["v"]) for r in trusted.collect() if r["v"]) == [("x", "old"), ("x", "old")]


def test_lines_of_a_table_are_simplified(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    df = spark.createDataFrame([(1, p((0, 0), (1, 0.01), (2, 0), (2, 4))), (2, None), (3, p((1, 1))), (4, [])], "id int, line array<struct<x:double,y:double>>")
    got = {r["id"]: r["s"] and [(q["x"], q["y"]) for q in r["s"]] for r in df.select("id", geo.simplify("line", 0.1).alias("s")).collect()}
    assert got == {1: [(0, 0), (2, 0), (2, 4)], 2: None, 3: [(1, 1)], 4: []}


def test_a_hub_is_split_over_tasks(spark):
    from oreline.operators.graph import _with_least

    star = spark.range(1, 2000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    dealt = _with_least(star, 4)
    assert dealt.where("low <> 1").count() == 0 and dealt.count() == 1999
    found = graph.connected_components(star, "u", "v")
    assert found.where("component <> 0").count() == 0 and found.count() == 2000


def test_shared_folder_is_refused_off_one_machine(spark, monkeypatch):
    class Elsewhere:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = Elsewhere()

    with pytest.raises(ValueError, match="share"):
        storage.shared_root(Session())


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert sinks.replayed_equal(df, df.orderBy(F.desc("id")).repartition(3), ["id", "x"])
    assert not sinks.replayed_equal(df, df.withColumn("x", F.col("x") + 1), ["id", "x"])


@pytest.mark.parametrize("volume,ok,shares", [(10, [1, 1, 1], [4, 3, 3]), (-10, [1, 1, 1], [-4, -3, -3]), (7, [0, 1, 1], [0, 4, 3]), (5, [0, 0, 0], [0, 0, 0]), (0, [1, 1, 0], [0, 0, 0])])
def test_equal_shares(spark, volume, ok, shares):
    df = spark.createDataFrame([("g", f"m{i}", volume, bool(o)) for i, o in enumerate(ok)], "g string, m string, v long, ok boolean")
    got = [r["share"] for r in allocation.equal_shares(df, ["g"], "m", "v", "ok").orderBy("m").collect()]
    assert got == shares and (sum(got) == volume or not any(ok))


# Graph and lineage


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    for n, m in ((60, 40), (40, 200), (30, 0)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 140)] if m else []) + [(None, 3), (4, 4)]
        parent = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                i = parent[i]
            return i

        for a, b in edges:
            if a is not None and a != b:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
        got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {i: root(i) for i in list(parent)}


def test_walk_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "s string, t string")
    got = {r["node"]: r["depth"] for r in lineage.walk(edges, spark.createDataFrame([("a",)], "r string"), "s", "t", depth=5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    short = lineage.walk(edges, spark.createDataFrame([("a",)], "r string"), "s", "t", depth=1)
    assert lineage.truncated(edges, short, "s", 1).count() == 1


def test_capture_nests_and_records_failure(spark):
    log = []
    with lineage.derive(log, "outer", "mart", x=1):
        with lineage.derive(log, "inner", "stage"):
            pass
        with pytest.raises(RuntimeError), lineage.derive(log, "broken", "stage"):
            raise RuntimeError
    assert [d.status for d in log] == ["complete", "failed", "complete"]
    assert log[-1].inputs == [("derivation", log[0].derivation_id, "nested")]
    nodes, edges = lineage.lineage_frames(spark, log)
    assert nodes.count() == 3 and edges.count() == 1
    assert lineage.content_id("drv", {"b": 1, "a": 2}) == lineage.content_id("drv", {"a": 2, "b": 1})


def test_manifest_supersession(spark):
    cols = "manifest_id string, source_id string, source_key string, sha256 string, fetch_vintage date"
    have = spark.createDataFrame([("m1", "s", "k", "h1", D(2024, 1, 1))], cols)
    new = spark.createDataFrame([("m2", "s", "k", "h1", D(2024, 2, 1)), ("m3", "s", "k", "h2", D(2024, 2, 1)), ("m4", "s", "j", "h1", D(2024, 2, 1))], cols)
    got = {r["manifest_id"]: r["supersedes_manifest_id"] for r in lineage.register_manifests(have, new).collect()}
    assert got == {"m3": "m1", "m4": None}


# Paging and planning


def test_cursor_round_trip_and_mismatch():
    c = paging.encode_cursor([5, "x"], "2024-01-01", {"q": 1})
    assert paging.decode_cursor(c, {"q": 1}) == ([5, "x"], "2024-01-01")
    for cursor, params in ((c, {"q": 2}), ("???", {"q": 1})):
        with pytest.raises(ValueError):
            paging.decode_cursor(cursor, params)


def test_layers_isolate_cycles():
    assert scheduling.layers(["a", "b", "c", "d", "e"], [("b", "a"), ("c", "d"), ("d", "c"), ("e", "c")]) == ([["a"], ["b"]], ["c", "d", "e"])


def test_scope_terms():
    assert serving.scope_set(["tx,nd", "TX"], {"TX", "ND"}) == ["ND", "TX"] and serving.scope_set(["all"], {"TX"}) is None
    for bad in (["all", "tx"], ["zz"]):
        with pytest.raises(ValueError):
            serving.scope_set(bad, {"TX"})


# Models


def test_split_keeps_groups_whole_and_guards_large_ones(spark):
    rows = [(i, i // 2, D(2020, 1, 1) + dt.timedelta(days=30 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, g int, d date")
    out = modeling.temporal_split(df, "k", "g", "d", F.lit("2022-06-01").cast("date"), most_share=0.1)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["split"] for r in out.collect()} == {"train", "calibration", "test"}
    with pytest.raises(ValueError):
        modeling.temporal_split(df, "k", "g", "d", F.lit("2022-06-01").cast("date"), most_share=0.01)


def test_withheld_keys_override_every_label(spark):
    rows = [("a", D(2020, m, 1), 10, "reported") for m in range(1, 7)] + [("b", D(2020, m, 1), 10, "reported") for m in range(1, 7)]
    df = spark.createDataFrame(rows, "k string, m date, oil int, f string")
    out = modeling.cumulative_labels(df, "k", "m", ["oil"], "f", horizons=(3,), withheld_keys=spark.createDataFrame([("b",)], "k string"))
    assert {r["k"]: (r["status"], r["value"]) for r in out.collect()} == {"a": ("complete", 30), "b": ("withheld", None)}


# Geometry


def test_near_pairs_and_pads_against_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100), D(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 300))) for i in range(150)]
    df = spark.createDataFrame(pts + [(999, None, 1.0, None)], "k int, x double, y double, d date")
    got = {(r["a"], r["b"]) for r in geo.near_pairs(df, "k", "x", "y", 7.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:3], b[1:3]) <= 7.0}


def test_projections_and_lengths(spark):
    x, y = (one(spark, c) for c in geo.utm(F.lit(-105.0), F.lit(40.0)))
    assert abs(x - 500000) < 0.01 and abs(y - 4427757.22) < 1
    x, y = (one(spark, c) for c in geo.albers(F.lit(-96.0), F.lit(23.0)))
    assert abs(x) < 1e-6 and abs(y) < 1e-6
    degree = one(spark, geo.ellipsoidal_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(degree - 110574.3) < 2
    assert abs(one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 111195.1) < 1


def test_polygon_tests(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(0, 0), p(4, 0), p(4, 4), p(2, 1), p(0, 4), p(0, 0))
    inside = lambda x, y: one(spark, geo.inside_ring(F.lit(x), F.lit(y), ring))
    assert inside(1.0, 1.0) and not inside(2.0, 3.0) and not inside(5.0, 1.0)
    assert one(spark, geo.ring_area(ring)) == 10.0
    with pytest.raises(ValueError):
        geo.in_box(F.col("x"), F.col("y"), (0, 0, 10, 1))


def test_simplify_keeps_ends_and_corners():
    line = [(0, 0), (1, 0.01), (2, 0), (2, 2), (2.01, 3), (2, 4)]
    assert geo.simplified(line, 0.1) == [(0, 0), (2, 0), (2, 4)]


# Sources, sinks, streams


def test_csv_header_is_judged_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1, x\n")
    assert files.read_csv(spark, str(tmp_path), ["a", "b"]).first()["b"] == " x"
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path), ["a"])


def test_zip_csv_and_inventory(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d.csv", "k}v\n1}é\n2}\n")
        z.writestr("readme.txt", "no")
    rows = files.read_zipped_csv(spark, str(tmp_path), r".*\.csv", ["k", "v"], sep="}").orderBy(files.ORDINAL).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("1", "é"), ("2", "")]
    assert [r["member"] for r in files.zip_inventory(spark, str(tmp_path)).orderBy("member").collect()] == ["d.csv", "readme.txt"]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>A</t></si><si><t>B</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>7.5</v></c></row></sheetData></worksheet>')
    row = files.read_workbook(spark, str(tmp_path), ["A", "B"], "S").first()
    assert row["A"] is None and row["B"] == "7.5" and row[files.ORDINAL] == 0


def test_shapes(spark, tmp_path):
    point = struct.pack("<i2d", 1, -105.0, 40.0)
    line = struct.pack("<i4d2i1i4d", 3, 0, 0, 1, 1, 1, 2, 0, 0.0, 0.0, 1.0, 1.0)
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((point, line)))
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15
    dbf = b"\3\0\0\0" + struct.pack("<IHH", 2, 65, 5) + b"\0" * 20 + field + b"\r" + b" ab  " + b" cd  "
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("l.shp", shp)
        z.writestr("l.dbf", dbf)
        z.writestr("l.prj", 'GEOGCS["GCS_North_American_1983",DATUM[]]')
    rows = files.read_zipped_shapes(spark, str(tmp_path), ["NAME"]).orderBy(files.ORDINAL).collect()
    assert [(r["NAME"], r["epsg"], len(r["parts"][0])) for r in rows] == [("ab", 4269, 1), ("cd", 4269, 2)]
    with pytest.raises(ValueError):
        files.epsg_of('PROJCS["Unknown"]')


def test_xml_geojson_and_positional(spark, tmp_path):
    (tmp_path / "x.xml").write_bytes("<rows><r><a>1</a><b> x </b></r><r><a>2</a></r></rows>".encode("utf-16"))
    rows, bad = files.read_xml_rows(spark, str(tmp_path / "x.xml"), "r", ["a", "b"])
    assert sorted(r["a"] for r in rows.collect()) == ["1", "2"] and bad.count() == 0
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"id":"7"},"geometry":{"type":"Point"}},{"properties":{},"geometry":null}]}\n')
    got = files.read_geojson_lines(spark, str(tmp_path / "g.json"), ["id"]).orderBy(files.ORDINAL).collect()
    assert [r["id"] for r in got] == ["7", None]
    (tmp_path / "p.txt").write_text('"42","x","9"\n"no","x"\n')
    kept, rejected = files.read_positional(spark, str(tmp_path / "p.txt"), ["k", "t"], 3, {0: "^[0-9]+$"})
    assert kept.first()["k"] == "42" and rejected.count() == 1


def test_publish_is_immutable_and_by_content(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    a, b = sinks.publish(df, f"file://{tmp_path}", ["id", "x"]), sinks.publish(df.orderBy(F.desc("id")), f"file://{tmp_path}", ["id", "x"])
    assert a == b and spark.read.parquet(a).count() == 10
    sinks.write_partition(df, f"file://{tmp_path}/p", ["id"])
    with pytest.raises(Exception):
        sinks.write_partition(df, f"file://{tmp_path}/p", ["id"])


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = forms.events(spark, str(tmp_path / "in"), batch.schema)
    forms.run_to_table(forms.tumbling(stream, "ts", "1 hour", ["event_type"], late="40 days"), "tumbled", "complete")
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.table("tumbled").count() == want.count() and spark.table("tumbled").agg(F.sum("n")).first()[0] == batch.count()
    forms.run_to_table(forms.sessions(stream, "ts", "6 hours", ["user_id"], late="40 days"), "sessions", "complete")
    assert spark.table("sessions").count() == batch.groupBy(F.session_window("ts", "6 hours"), "user_id").count().count()


def test_stream_append_is_change_only(spark, tmp_path):
    schema = "k string, v date, x int"
    store = str(tmp_path / "store")
    spark.createDataFrame([("a", D(2024, 1, 1), 1)], schema).write.parquet(store)
    spark.createDataFrame([("a", D(2024, 2, 1), 1), ("b", D(2024, 2, 1), 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = forms.events(spark, str(tmp_path / "in"), spark.read.parquet(store).schema)
    for run in ("one", "two"):  # the second run sees all files again
        forms.append_changes(stream, store, ["k"], "v", "x", str(tmp_path / run)).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(store).collect()) == ["a", "b"]


def test_paged_walks_are_reconciled(spark):
    pages = lambda rows: files.reconcile_pages(spark.createDataFrame(rows, "page int, declared int, k string"), "page", "declared", "k").first()["fault"]
    assert pages([(1, 2, "a"), (2, 2, "b")]) is None
    assert pages([(1, 3, "a"), (2, 3, "b")]) == "short"
    assert pages([(1, 2, "a"), (2, 2, "a")]) == "duplicate_rows"
    assert pages([(1, 1, "a"), (2, 1, "b")]) == "more_than_declared"


def test_tables_append_rebuild_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    path = f"file://{tmp_path}/t"
    sinks.append_rows(df, path, ["k", "v"])
    sinks.append_rows(df, path, ["k", "v"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.append_rows(df.withColumn("x", F.lit(1)), path, ["k", "v"])
    sinks.rebuild(df, path)
    assert spark.read.parquet(path).count() == 1
    sinks.export_csv(df, f"{path}-csv", {"source": "s1"})
    assert spark.read.option("header", True).csv(f"{path}-csv").first()["source"] == "s1"
    assert sinks.coverage_document(df.agg(F.count("*").alias("n"), F.max("v").alias("m"))).first()["document"] == '{"m":1,"n":1}'
    sinks.named_views(spark, {"exported": path})
    assert spark.table("exported").count() == 1


def test_point_facts(spark):
    fact = lambda has, f, pending, lease: one(spark, serving.point_fact(F.lit(has), F.lit(f).cast("string"), F.lit(pending), F.lit(lease)))
    assert fact(True, "reported", False, False) == "reported" and fact(False, None, False, False) == "no_report"
    assert fact(True, "reported", True, True) == "multi_pool_pending" and fact(True, "reported", False, True) == "lease_reported"


def test_monthly_jobs_fall_due(spark):
    jobs = spark.createDataFrame([("m", "monthly", None, 31, D(2024, 1, 31)), ("n", "monthly", None, 5, D(2024, 2, 6)), ("o", "cadence", 7, None, None)], "job string, kind string, every_days int, month_day int, last_success date")
    got = {r["job"]: (r["next_due"], r["due"]) for r in scheduling.next_due(jobs, F.lit("2024-02-29").cast("date")).collect()}
    assert got == {"m": (D(2024, 2, 29), True), "n": (D(2024, 3, 5), False), "o": (D(2024, 2, 29), True)}
    january = scheduling.next_due(jobs, F.lit("2024-01-31").cast("date")).collect()
    assert {r["job"]: r["next_due"] for r in january}["m"] == D(2024, 2, 29)  # the 31st, clamped


def test_jobs_that_follow_another(spark):
    rows = [("load", "cadence", 7, None, D(2024, 2, 10), None), ("mart", "after", None, None, D(2024, 2, 9), "load"), ("map", "after", None, None, D(2024, 2, 10), "load"), ("new", "after", None, None, None, "load"), ("lost", "after", None, None, None, "nothing")]
    jobs = spark.createDataFrame(rows, "job string, kind string, every_days int, month_day int, last_success date, after_job string")
    out = scheduling.next_due(jobs, F.lit("2024-02-11").cast("date"))
    assert out.columns == [*jobs.columns, "next_due", "due"]
    got = {r["job"]: (r["next_due"], r["due"]) for r in out.collect()}
    assert got == {"load": (D(2024, 2, 17), False), "mart": (D(2024, 2, 10), True), "map": (None, False), "new": (D(2024, 2, 10), True), "lost": (None, False)}


def test_a_batch_may_not_contradict_itself(spark, tmp_path):
    schema = "k string, v date, x int"
    store = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("c", D(2024, 1, 1), 9)], schema)
    frame = lambda *rows: spark.createDataFrame([(k, D(2024, 2, 1), x) for k, x in rows], schema)
    for bad in (frame(("b", 5), ("b", 6)), frame(("b", None), ("b", 6))):
        with pytest.raises(ValueError, match="two values"):
            append.bitemporal_append(store, bad, ["k"], "v", "x")
    again = append.bitemporal_append(store, frame(("b", 5), ("b", 5), (None, None), (None, None), ("a", 1)), ["k"], "v", "x")
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, [("b", D(2024, 2, 1), 5), (None, D(2024, 2, 1), None)]))
    store.write.parquet(str(tmp_path / "store"))
    frame(("b", 5), ("b", 6)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = forms.append_changes(forms.events(spark, str(tmp_path / "in"), store.schema), str(tmp_path / "store"), ["k"], "v", "x", str(tmp_path / "check"))
    with pytest.raises(Exception, match="two values"):
        stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_landed_files_have_content_addresses(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"x")
    rows = files.landed(spark, str(tmp_path), "s", F.lit("2024-01-01").cast("date")).collect()
    assert len({r["sha256"] for r in rows}) == 1 and len({r["manifest_id"] for r in rows}) == 2


def test_datum_grid_forward_and_back(spark, tmp_path):
    step = 0.25
    (tmp_path / "grid.csv").write_text("# lon, lat, seconds east, seconds north\n" + "\n".join(f"{-104 + i * step},{47 + j * step},{3.6 * (i + 0.3 * i * j)},{-1.8 * j * j}" for i in range(5) for j in range(4) if (i, j) != (4, 3)) + "\n-103.9,47.1,9,9\n")
    grid = datum.read_grid(spark, str(tmp_path / "grid.csv"), step)
    assert grid.count() == 19
    points = [(1, -103.9, 47.1), (2, -103.5001, 47.2499), (3, -103.3, 47.6), (4, -105.0, 47.1), (5, None, 47.1), (6, -103.01, 47.7)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    out = {r["k"]: r for r in datum.shifted(df, "x", "y", grid, step).collect()}
    assert [out[k]["datum_fact"] for k in range(1, 7)] == ["shifted", "shifted", "shifted", "datum_undetermined", "no_geometry", "datum_undetermined"]
    u, v = (0.1 / step, 0.1 / step)
    assert abs(out[1]["x_shifted"] - (-103.9 + (u + 0.3 * u * v) / 1000)) < 1e-9 and abs(out[1]["y_shifted"] - (47.1 - 0.0005 * v)) < 1e-9
    moved = spark.createDataFrame([(k, r["x_shifted"], r["y_shifted"]) for k, r in out.items() if r["datum_fact"] == "shifted"], df.schema)
    for r in datum.shifted(moved, "x", "y", grid, step, inverse=True).collect():
        assert abs(r["x_shifted"] - out[r["k"]]["x"]) < 1e-9 and abs(r["y_shifted"] - out[r["k"]]["y"]) < 1e-9
    twice = grid.union(grid.limit(1).selectExpr("gx", "gy", "dx + 1", "dy"))
    assert datum.cells(twice).count() < datum.cells(grid).count() == datum.cells(grid.union(grid)).count()


def test_rules_with_frames(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, "a"), (2, 5.0, 5.0, "b")], "k int, x double, y double, code string")
    grid = spark.createDataFrame([(i, j, 0.001, 0.002) for i in (0, 1) for j in (0, 1)], "gx long, gy long, dx double, dy double")
    move = rules.Rule("r", "datum_transform", {"frame": "g", "x": "x", "y": "y", "source": "NAD27", "target": "WGS84", "step": 1.0})
    kept, (lost,) = rules.apply_rules(df, [move], {"g": grid})
    assert [tuple(r) for r in kept.select("k", "x", "y").collect()] == [(1, 0.501, 0.502)] and lost.first()["reason_code"] == "datum_undetermined"
    same = rules.Rule("r", "datum_transform", move.spec | {"source": "NAD83", "same": [["NAD83", "WGS84"]]})
    assert rules.apply_rules(df, [same], {"g": grid})[0].count() == 2
    with pytest.raises(ValueError, match="no frame"):
        rules.apply_rules(df, [move])


def test_supersession_chains(spark):
    chain = lambda rows: lineage.supersession_chain(spark.createDataFrame(rows, "manifest_id string, supersedes_manifest_id string"))
    rows = [(f"m{i:02}", f"m{i - 1:02}" if i else None) for i in range(13)] + [("x", None), ("y", "gone")]
    got = {r["manifest_id"]: (r["head"], r["place"]) for r in chain(rows).collect()}
    assert got == {f"m{i:02}": ("m12", 12 - i) for i in range(13)} | {"x": ("x", 0), "y": ("y", 0)}
    for bad in ([("a", "b"), ("b", "a")], [("a", "c"), ("b", "c"), ("c", None)], [("a", "a")]):
        with pytest.raises(ValueError):
            chain(bad)
    assert chain([("only", None)]).collect()[0]["place"] == 0


def test_coverage_share_rounds_as_its_sql(spark, tmp_path):
    """0.30504996 is 3050.500 to three decimals and then 3051; rounded at once it was 3050."""
    spark.createDataFrame([(1, "P", 305049.96), (1, "F", 694950.04)], "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r["share_4dp"] for r in QUERIES["agg04_coverage"](spark, str(tmp_path)).collect()] == [3051]


@pytest.mark.parametrize("name", ["jon22_values_lookup", "jon02_status_resolver"])
def test_listed_rows_are_not_shuffled_to(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ended_chains_are_not_joined(spark):
    """Manifests that point nowhere stay where they are: joined on their null pointer, they all were one task's."""
    now = spark.range(4000).selectExpr("id AS node", "IF(id % 100 = 1, id - 1, NULL) AS ahead", "IF(id % 100 = 1, id - 1, id) AS head", "IF(id % 100 = 1, 1L, 0L) AS place").repartition(4)
    moved = lineage._doubled(now)
    assert sorted(map(tuple, moved.collect())) == sorted(((i, None, i - 1, 1) if i % 100 == 1 else (i, None, i, 0)) for i in range(4000))
    per_task = [r["count"] for r in moved.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 2000


def test_edges_of_single_points_are_not_grouped(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 50.0, 0.0)], "k long, x double, y double")
    edges = geo.neighbour_edges(rows, "k", "x", "y", 6.0)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 5.0), (2, 1, 5.0)]
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    twice = geo.neighbour_edges(rows.union(spark.createDataFrame([(2, 0.0, 1.0)], rows.schema)), "k", "x", "y", 6.0)
    assert sorted(map(tuple, twice.collect())) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_coverage_share_just_below_a_half_is_not_lifted(spark, tmp_path):
    """0.30504994997 is 3050.499 to three decimals and then 3050; rounded to ten places before, it was 3051."""
    rows = [(1, "P", 305049949.97), (1, "F", 694950050.03), (2, "F", 5.0), (3, "P", 0.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_custkey"]: r["share_4dp"] for r in QUERIES["agg04_coverage"](spark, str(tmp_path)).collect()}
    assert got == {1: 3050, 2: 0, 3: None}
    df = spark.createDataFrame([(1, 12344999999, True), (1, 87655000001, False), (2, -1, True), (2, 7999, False), (3, None, True), (4, 0, False)], "k long, v long, a boolean")
    shares = {r["k"]: (r["outcome"], r["allocated_share"] and str(r["allocated_share"])) for r in aggregates.coverage(df, ["k"], "v", "a").collect()}
    assert shares == {1: ("observed_with_allocated", "0.1234"), 2: ("observed_with_allocated", "0.0001"), 3: ("never_reported", None), 4: ("observed", None)}

"""Lines and polygons against all pairs, rasters and published lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import geo, lines, polygons
from oreline.plans.catalog import QUERIES

LINE = "k long, part long, line array<struct<x:double,y:double>>"
POLYGON = "k long, rings array<array<struct<x:double,y:double>>>"


def gap(a, b):
    """Least distance of two polylines by dense formulas in plain Python."""

    def end(p, u, v):
        w = (v[0] - u[0], v[1] - u[1])
        n = w[0] ** 2 + w[1] ** 2
        t = max(0.0, min(1.0, ((p[0] - u[0]) * w[0] + (p[1] - u[1]) * w[1]) / n)) if n else 0.0
        return math.hypot(p[0] - u[0] - t * w[0], p[1] - u[1] - t * w[1])

    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    legs = lambda line: list(zip(line, line[1:])) or [(line[0], line[0])]
    best = math.inf
    for u, v in legs(a):
        for p, q in legs(b):
            if side(u, v, p) * side(u, v, q) < 0 and side(p, q, u) * side(p, q, v) < 0:
                return 0.0
            best = min(best, end(u, p, q), end(v, p, q), end(p, u, v), end(q, u, v))
    return best


def some_lines(rnd, n, step=12.0):
    out = []
    for _ in range(n):
        x, y = rnd.uniform(-50, 50), rnd.uniform(-50, 50)
        line = [(x, y)]
        for _ in range(rnd.randint(0, 5)):
            line.append(rnd.choice([(line[-1][0] + rnd.uniform(-step, step), line[-1][1] + rnd.uniform(-step, step)), (line[-1][0], line[-1][1] + rnd.uniform(-40, 40)), line[-1]]))
        out.append(line)
    return out


@pytest.mark.parametrize("radius", [0.5, 7.0, 60.0])
def test_near_lines_are_those_of_all_pairs(spark, radius):
    rnd = random.Random(4)
    rows = [(i // 2, i, line) for i, line in enumerate(some_lines(rnd, 70))]
    df = spark.createDataFrame([*rows, (90, 1, None), (91, 1, [])], LINE)
    got = {(r["a"], r["b"], r["a_part"], r["b_part"]): r["distance"] for r in lines.near_lines(df, "k", "part", "line", radius).collect()}
    want = {(a, b, i, j): gap(p, q) for a, i, p in rows for b, j, q in rows if a < b and gap(p, q) <= radius}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert all(abs(lines.line_distance(np.array(p, float), np.array(q, float)) - gap(p, q)) < 1e-9 for _, _, p in rows[:20] for _, _, q in rows[:20])


def test_laterals_take_the_nearest_pair_in_its_zone(spark):
    rnd = random.Random(9)
    rows = [(i // 2, i, [(-102.005 + rnd.uniform(-0.02, 0.02), 47 + rnd.uniform(-0.02, 0.02)) for _ in range(3)]) for i in range(30)]
    got = lines.neighbour_laterals(spark.createDataFrame(rows, LINE), "k", "part", "line", candidate_radius=620.0, radius=600.0).collect()
    assert {r["epsg"] for r in got} <= {32613, 32614} and len(got) > 10
    assert {(r["b"], r["a"], r["distance"]) for r in got} == {(r["a"], r["b"], r["distance"]) for r in got}
    best = {}
    for a, i, p in rows:
        for b, j, q in rows:
            if a != b:
                for zone in (13, 14):
                    d = gap(*([tuple(v) for v in lines._utm_xy(np.array(x), zone)] for x in (p, q)))
                    best.setdefault((a, b, zone), []).append((d, i, j))
    for r in (r for r in got if r["a"] < r["b"]):
        d, i, j = min(best[r["a"], r["b"], r["epsg"] - 32600])
        assert abs(d - r["distance"]) < 0.001 and (i, j) == (r["a_part"], r["b_part"])
    found = {(r["a"], r["b"]) for r in got}
    assert all((a, b) in found for (a, b, z), all_ in best.items() if min(all_)[0] < 590 and min(best[a, b, 27 - z])[0] < 590)


def test_zone_projection_agrees_with_the_series(spark):
    lonlat = [(-103.7, 47.9), (-105.0, 40.0), (-99.2, 31.5)]
    rows = spark.createDataFrame(lonlat, "x double, y double").select(*geo.utm(F.col("x"), F.col("y"))).collect()
    for (x, y), r in zip(lonlat, rows):
        assert np.allclose(lines._utm_xy(np.array([(x, y)]), int((x + 180) // 6) + 1)[0], tuple(r), atol=0.01)
    assert spark.range(1).select(geo.utm_zone_epsg(F.lit(180.0)).alias("z")).first()["z"] == 32660
    back = spark.createDataFrame(lonlat, "x double, y double").select("x", geo.albers_longitude(*geo.albers(F.col("x"), F.col("y"))).alias("l")).collect()
    assert all(abs(r["x"] - r["l"]) < 1e-9 for r in back)


def test_published_geodesic_lengths():
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    cases = [
        (dms(144, 25, 29.5244), dms(-37, 57, 3.7203), dms(143, 55, 35.3839), dms(-37, 39, 10.1561), 54972.271, 1e-3),
        (0, 0, 0, 90, 10001965.7293, 1e-4), (0, 0, 1, 0, 111319.490793, 1e-6), (10, 10, 10, 10, 0.0, 0), (179.5, 0, -179.5, 0, 111319.490793, 1e-6), (0, 0, 180, 0, 20003931.4586, 1e-3),
    ]
    got = lines.geodesic_metres(*(np.array([c[i] for c in cases], float) for i in range(4)))
    assert all(abs(g - c[4]) <= c[5] for g, c in zip(got, cases))
    assert np.isnan(lines.geodesic_metres(np.array([np.nan]), np.zeros(1), np.zeros(1), np.zeros(1)))[0]


def test_tile_pieces_add_up_to_the_line(spark):
    rnd = random.Random(3)
    rows = [(i, 0, [(rnd.uniform(-120, -90), rnd.uniform(30, 50)) for _ in range(4)]) for i in range(25)]
    df = spark.createDataFrame(rows, LINE)
    pieces = lines.tile_pieces(df, "k", "line", 7, buffer=0.0, grid=1 << 20).collect()
    world = lambda p: ((p[0] + 180) / 360 * 128, (1 - math.asinh(math.tan(math.radians(p[1]))) / math.pi) / 2 * 128)
    for k, _, line in rows:
        total = sum(math.dist(world(a), world(b)) for a, b in zip(line, line[1:]))
        assert abs(sum(math.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"]) for r in pieces if r["k"] == k) / (1 << 20) - total) < 1e-3
    assert len({(r["x"], r["y"], r["k"], r["leg"]) for r in pieces}) == len(pieces)
    wide = lines.tile_pieces(df, "k", "line", 7).collect()
    assert all(-64 <= r[c] <= 4096 + 64 for r in wide for c in ("x0", "y0", "x1", "y1"))
    assert {(r["x"], r["y"], r["k"]) for r in pieces} <= {(r["x"], r["y"], r["k"]) for r in wide}


def even_odd(x, y, rings):
    inside = False
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for (ax, ay), (bx, by) in zip(closed, closed[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def random_polygons(rnd, n, side=24):
    out = []
    for k in range(n):
        rings = [[(float(rnd.randint(0, side)), float(rnd.randint(0, side))) for _ in range(rnd.randint(3, 9))] for _ in range(rnd.randint(1, 3))]
        out.append((k, [r if rnd.random() < 0.3 else [*r, r[0]] for r in rings]))
    return out


@pytest.mark.parametrize("cell", [1.0, 5.0, 100.0])
def test_repair_keeps_the_inside(spark, cell):
    rnd = random.Random(11)
    rows = random_polygons(rnd, 60)
    df = spark.createDataFrame(rows, POLYGON)
    mended = polygons.repaired(df, "k", "rings", cell)
    out = {r["k"]: r for r in mended.collect()}
    again = {r["k"]: r for r in polygons.faults(mended, "k", "rings", cell).collect()}
    for k, rings in rows:
        new = [[(p["x"], p["y"]) for p in r] for r in out[k]["rings"]]
        points = [(rnd.uniform(-1, 25), rnd.uniform(-1, 25)) for _ in range(400)]
        assert [even_odd(*p, rings) for p in points] == [even_odd(*p, new) for p in points]
        assert again[k]["reason"] in (None, "empty") and all(r[0] == r[-1] for r in new)
    cells = [(i / 40 + 1 / 79, j / 40 + 1 / 83) for i in range(24 * 40) for j in range(24 * 40)]
    for k, rings in rows[:2]:
        raster = sum(even_odd(x, y, rings) for x, y in cells) / 1600
        assert abs(raster - out[k]["area"]) < 2.0


def test_crossed_rings_are_faults(spark):
    shapes = [
        (0, [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]), (1, [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]), (2, [[(0, 0), (4, 0)]]), (3, [[(0, 0), (4, 0), (4, 4), (0, 4)]]),
        (4, [[(0, 0), (2, 0), (4, 0), (0, 0)]]), (5, []), (6, None), (7, [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 0), (4, 2), (2, 2), (2, 0)]]),
    ]
    df = spark.createDataFrame([(k, r and [[(float(x), float(y)) for x, y in ring] for ring in r]) for k, r in shapes], POLYGON)
    got = {r["k"]: r["reason"] for r in polygons.faults(df, "k", "rings", 3.0).collect()}
    assert got == {0: "self_crossing", 1: None, 2: "too_few_points", 3: "not_closed", 4: "self_crossing", 5: "empty", 6: "empty", 7: "self_crossing"}


@pytest.mark.parametrize("cell", [0.7, 4.0, 50.0])
def test_points_in_polygons_of_any_shape(spark, cell):
    rnd = random.Random(12)
    rows = random_polygons(rnd, 25)
    points = [(i, rnd.uniform(-2, 26), rnd.uniform(-2, 26)) for i in range(600)]
    covered = polygons.cover(spark.createDataFrame(rows, POLYGON), "k", "rings", cell)
    got = polygons.points_in(spark.createDataFrame(points, "i long, px double, py double"), "px", "py", covered, "k", cell).select("i", "k").collect()
    want = [(i, k) for i, x, y in points for k, rings in rows if even_odd(x, y, rings)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_cover_grows_with_the_boundary(spark):
    circle = lambda r: [[(r * math.cos(t / 200 * math.pi), r * math.sin(t / 200 * math.pi)) for t in range(400)]]
    counts = [polygons.cover(spark.createDataFrame([(1, circle(r))], POLYGON), "k", "rings", 1.0).count() for r in (50.0, 200.0)]
    assert counts[1] < 4.6 * counts[0] and counts[1] < 200 * 200


def test_parts_chain_in_any_order(spark):
    rnd = random.Random(5)
    line = [(float(i), float(i % 3)) for i in range(20)]
    for _ in range(20):
        cuts = [0, *sorted(rnd.sample(range(1, 19), 4)), 19]
        parts = [line[a : b + 1] for a, b in zip(cuts, cuts[1:])]
        rnd.shuffle(parts)
        parts = [p if rnd.random() < 0.5 else p[::-1] for p in parts]
        assert lines.chained(parts) == [min(line, line[::-1])]
        assert lines.anchor_of(parts) == lines.anchor_of([line])
    fork = [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 1.0)], [(1.0, 0.0), (2.0, -1.0)]]
    assert len(lines.chained(fork)) == 3 and lines.anchor_of(fork) == lines.anchor_of(fork[::-1])
    loop = [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 1.0), (1.0, 0.0)], [(1.0, 1.0), (0.0, 0.0)]]
    assert len(lines.chained(loop)) == 1 and len(lines.chained(loop)[0]) == 4
    rows = [(1, 0, line[:8]), (1, 1, line[7:]), (2, 0, None), (3, 0, []), (4, 0, [(5.0, 6.0)])]
    got = {r["k"]: (r["x"], r["y"]) for r in lines.anchors(spark.createDataFrame(rows, LINE), ["k"], "line").collect()}
    assert got == {1: lines.anchor_of([line]), 2: (None, None), 3: (None, None), 4: (5.0, 6.0)}


def test_label_anchors_lie_inside(spark):
    rnd = random.Random(13)
    rows = random_polygons(rnd, 40) + [(100, [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (8.0, 1.0), (8.0, 8.0), (1.0, 8.0), (1.0, 1.0)]])]
    rows += [(101, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), (102, []), (103, None), (104, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0), (0.0, 0.0)]])]
    df = spark.createDataFrame(rows, POLYGON)
    got = {r["k"]: r for r in polygons.label_anchors(df, "k", "rings", 6).collect()}
    for k, rings in rows:
        if k in (101, 102, 103):
            assert got[k]["x"] is None and got[k]["tile_x"] is None
        elif got[k]["x"] is not None:
            assert even_odd(got[k]["x"], got[k]["y"], rings)
    assert sum(r["x"] is None for r in got.values()) < 6


def test_plans_of_repaired_polygons_do_not_nest(spark, sf_dir):
    """Faults of repaired shapes are planned from written edges and rings, not from all that made them (212,846 characters before)."""
    found = QUERIES["geo10_validity"](spark, sf_dir)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_edges_of_polygons_are_not_broadcast(spark, sf_dir):
    """Files of like shapes are a small part of their rows' size, so a broadcast sized by them fills the driver (every join was one before)."""
    found = QUERIES["geo10_validity"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_gaps_and_zone_distances_in_batches_are_those_of_single_pairs():
    rnd = random.Random(8)
    some = [[(rnd.randint(0, 9) / 1000 - 97, rnd.randint(0, 9) / 1000 + 40) for _ in range(rnd.choice([1, 2, 2, 2, 5]))] for _ in range(120)]
    pairs = [(rnd.choice(some), rnd.choice(some), rnd.choice([13, 14, 15])) for _ in range(400)]
    flat = lambda i: (np.array([q for p in pairs for q in p[i]], float), np.cumsum([0, *(len(p[i]) for p in pairs)]))
    found = lines.zone_distances(flat(0), flat(1), np.array([z for *_, z in pairs]))
    want = [lines.line_distance(*(lines._utm_xy(np.array(line, float), z) for line in (a, b))) for a, b, z in pairs]
    assert np.allclose(found, want, rtol=0, atol=1e-9)
    ends = np.array([[rnd.randint(0, 6) for _ in range(8)] for _ in range(500)], float)
    d, x, y = lines.segment_gaps(*ends.T)
    for row, one, u, v in zip(ends.tolist(), d, x, y):
        p, q = (row[:2], row[2:4]), (row[4:6], row[6:])
        assert abs(one - gap(p, q)) < 1e-9 and abs(gap([(u, v)] * 2, p) + gap([(u, v)] * 2, q) - one) < 1e-9


def test_lines_of_one_file_are_tiled_in_several_tasks(spark):
    rows = spark.range(40, numPartitions=1).select("id", F.expr("array(named_struct('x', -100D + id, 'y', 40D), named_struct('x', -96D + id, 'y', 41D))").alias("line"))
    assert lines.tile_pieces(rows, "id", "line", 8).rdd.getNumPartitions() > 1


def test_pairs_of_laterals_are_not_shuffled(spark, sf_dir):
    """Edges grow with the square of the density, wells do not: behind the measuring of pairs nothing is exchanged (three shuffles of all pairs before)."""
    for name in ("geo06_lateral_edges", "jon07_line_neighbours"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0] and plan.count("Join") == 1


@pytest.mark.parametrize("radius", [1.0, 2.0])
def test_lines_at_the_borders_of_cells_are_paired_once(spark, radius):
    rnd = random.Random(21)
    rows = [(i // 2, i % 2, [(float(rnd.randint(-6, 6)), float(rnd.randint(-6, 6))) for _ in range(rnd.choice([1, 2, 2, 4]))]) for i in range(60)]
    got = [((r["a"], r["b"], r["a_part"], r["b_part"]), r["distance"]) for r in lines.near_lines(spark.createDataFrame(rows, LINE), "k", "part", "line", radius).collect()]
    want = {(a, b, i, j): gap(p, q) for a, i, p in rows for b, j, q in rows if a < b}
    assert len(got) == len(dict(got)) and all(abs(d - want[pair]) < 1e-9 for pair, d in got)
    assert {p for p, d in want.items() if d <= radius - 1e-9} <= set(dict(got)) <= {p for p, d in want.items() if d <= radius + 1e-9}

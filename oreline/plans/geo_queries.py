"""Geospatial queries: embeddings' first two components as planar points, keys as coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import geo
from oreline.operators import windows as W
from oreline.plans.registry import Tables, day, query

# Whole-number coordinates: sums and products are exact in both engines.
_POINTS = "SELECT vec_id, floor(embedding[1]::DOUBLE * 1000) AS x, floor(embedding[2]::DOUBLE * 1000) AS y, label FROM embeddings"
_LONLAT = "SELECT c_custkey, -105.0 + (c_custkey % 97) / 16.0 AS lon, 40.0 + (c_custkey % 89) / 32.0 AS lat, c_nationkey FROM customer"


def _points(t: Tables):
    x = lambda i: F.floor(F.element_at("embedding", i).cast("double") * 1000).cast("double")
    return t.embeddings.select("vec_id", x(1).alias("x"), x(2).alias("y"), "label")


def _lonlat(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", (F.lit(-105.0) + (k % 97) / 16.0).alias("lon"), (F.lit(40.0) + (k % 89) / 32.0).alias("lat"), "c_nationkey")


@query("neighbor_edges", f"""
WITH p AS ({_POINTS}), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900.0)
SELECT a, b FROM e UNION ALL SELECT b, a FROM e""")
def neighbor_edges(t: Tables):
    return geo.neighbour_edges(_points(t), "vec_id", "x", "y", 30.0).select("a", "b")


@query("components", f"""
WITH RECURSIVE p AS ({_POINTS}), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225.0),
r(a, b) AS (SELECT vec_id, vec_id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS vec_id, min(b) AS "group" FROM r GROUP BY 1""")
def components(t: Tables):
    rows = _points(t).withColumn("d", F.lit("2024-01-01").cast("date"))
    return geo.pad_groups(rows, "vec_id", "x", "y", "d", 15.0, 180).select("vec_id", "group")


@query("geo08_pad_groups", f"""
WITH RECURSIVE p AS (SELECT *, DATE '2024-01-01' + (label * 40)::INTEGER AS d FROM ({_POINTS})),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND abs(a.d - b.d) <= 60 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400.0),
r(a, b) AS (SELECT vec_id, vec_id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS vec_id, min(b) AS "group" FROM r GROUP BY 1""")
def geo08_pad_groups(t: Tables):
    rows = _points(t).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("label") * 40))
    return geo.pad_groups(rows, "vec_id", "x", "y", "d", 20.0, 60).select("vec_id", "group")


@query("geo09_dbscan", f"""
WITH RECURSIVE p AS ({_POINTS}), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144.0),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY 1""")
def geo09_dbscan(t: Tables):
    return geo.dbscan_pairs(_points(t), "vec_id", "x", "y", 12.0)


@query("geo03_utm_zone", f"SELECT c_custkey, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM ({_LONLAT})")
def geo03_utm_zone(t: Tables):
    return _lonlat(t).select("c_custkey", geo.utm_zone_epsg(F.col("lon")).alias("epsg"))


@query("geo05_bbox", f"SELECT c_custkey FROM ({_LONLAT}) WHERE lon BETWEEN -104.0 AND -102.0 AND lat BETWEEN 40.5 AND 42.0")
def geo05_bbox(t: Tables):
    return _lonlat(t).where(geo.in_box(F.col("lon"), F.col("lat"), (-104.0, 40.5, -102.0, 42.0))).select("c_custkey")


@query("geo13_tiles", f"""
SELECT c_custkey, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tile_x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS tile_y FROM ({_LONLAT})""")
def geo13_tiles(t: Tables):
    x, y = geo.tile_of(F.col("lon"), F.col("lat"), 12)
    return _lonlat(t).select("c_custkey", x.alias("tile_x"), y.alias("tile_y"))


@query("geo02_mercator", f"SELECT c_custkey, CAST(round(radians(lon) * 6378137.0) AS BIGINT) AS x, CAST(round(asinh(tan(radians(lat))) * 6378137.0) AS BIGINT) AS y FROM ({_LONLAT})")
def geo02_mercator(t: Tables):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return _lonlat(t).select("c_custkey", F.round(x).cast("long").alias("x"), F.round(y).cast("long").alias("y"))


@query("geo01_path_length", """
WITH p AS (SELECT n_regionkey, n_nationkey, n_nationkey * 3.0 AS x, n_nationkey * 4.0 AS y FROM nation), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
SELECT n_regionkey, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0)) AS length FROM l GROUP BY 1""")
def geo01_path_length(t: Tables):
    pts = t.nation.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * F.lit(3.0)).alias("x"), (F.col("n_nationkey") * F.lit(4.0)).alias("y"))
    lines = pts.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "x", "y"))).alias("p"))
    return lines.select("n_regionkey", geo.path_length("p", geo.planar).alias("length"))


@query("geo07_midpoint", """
WITH p AS (SELECT n_regionkey, min(n_nationkey) AS a, max(n_nationkey) AS b FROM nation GROUP BY 1) SELECT n_regionkey, (a + b) / 2.0 * 3.0 AS x, (a + b) / 2.0 * 4.0 AS y FROM p""")
def geo07_midpoint(t: Tables):
    pts = t.nation.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * F.lit(3.0)).alias("x"), (F.col("n_nationkey") * F.lit(4.0)).alias("y"))
    lines = pts.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "x", "y"))).alias("p"))
    return lines.select("n_regionkey", geo.midpoint("p").alias("m")).select("n_regionkey", "m.x", "m.y")


_BOXES = "SELECT r_regionkey, r_regionkey * 100.0 - 300.0 AS x0, -250.0 AS y0, r_regionkey * 100.0 - 50.0 AS x1, 250.0 AS y1 FROM region"


def _boxes(t: Tables):
    k = F.col("r_regionkey")
    x0, x1 = k * F.lit(100.0) - 300.0, k * F.lit(100.0) - 50.0
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(x0, -250.0), corner(x1, -250.0), corner(x1, 250.0), corner(x0, 250.0), corner(x0, -250.0))
    return t.region.select("r_regionkey", ring.alias("ring"))


@query("jon08_point_in_polygon", f"SELECT p.vec_id, b.r_regionkey FROM ({_POINTS}) p JOIN ({_BOXES}) b ON p.x + 0.5 > x0 AND p.x + 0.5 < x1 AND p.y + 0.5 > y0 AND p.y + 0.5 < y1")
def jon08_point_in_polygon(t: Tables):
    pts = _points(t).withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})
    return geo.points_in_polygons(pts, _boxes(t), "x", "y", "ring", 100.0).select("vec_id", "r_regionkey")


@query("geo11_smallest_container", f"""
WITH h AS (SELECT p.vec_id, b.r_regionkey FROM ({_POINTS}) p LEFT JOIN ({_BOXES}) b ON p.x + 0.5 > x0 AND p.x + 0.5 < x1 AND p.y + 0.5 > y0 AND p.y + 0.5 < y1)
SELECT vec_id, min(r_regionkey) AS container, nullif(count(r_regionkey), 0) AS n_overlaps FROM h GROUP BY 1""")
def geo11_smallest_container(t: Tables):
    pts = _points(t).withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})
    return geo.smallest_container(pts, _boxes(t), "vec_id", "x", "y", "r_regionkey", "ring", 100.0).select("vec_id", "container", "n_overlaps")


@query("geo04_outside_domain", f"SELECT label, count(*) AS n FROM ({_POINTS}) WHERE x < -200 OR x > 200 OR y < -200 OR y > 200 GROUP BY 1")
def geo04_outside_domain(t: Tables):
    pts = _points(t).select("label", F.array(F.struct("x", "y")).alias("p"))
    return geo.outside_domain(pts, "label", "p", (-200.0, -200.0, 200.0, 200.0))


@query("win16_thinning", f"SELECT DISTINCT ON (floor(x / 50), floor(y / 50)) vec_id, CAST(floor(x / 50) AS BIGINT) AS cell_x, CAST(floor(y / 50) AS BIGINT) AS cell_y FROM ({_POINTS}) ORDER BY floor(x / 50), floor(y / 50), md5(vec_id::VARCHAR)")
def win16_thinning(t: Tables):
    return W.thinned(_points(t), "x", "y", 50.0, "vec_id").select("vec_id", "cell_x", "cell_y")


@query("win17_station_path", """
SELECT l_orderkey, count(*)::INTEGER AS n_stations, 'LINESTRING(' || string_agg(l_linenumber || ' ' || l_partkey, ', ' ORDER BY CAST(l_shipdate AS DATE), l_partkey, l_linenumber) || ')' AS wkt
FROM lineitem GROUP BY 1 HAVING count(*) >= 2""")
def win17_station_path(t: Tables):
    rows = t.lineitem.select("l_orderkey", day("l_shipdate").alias("d"), F.col("l_partkey").alias("tie"), F.col("l_linenumber").alias("x"), F.col("l_partkey").alias("y"))
    return W.station_path(rows, ["l_orderkey"], "d", "x", "y", "tie")


@query("geo16_duplicate_survivor", f"SELECT label, vec_id = min(vec_id) OVER (PARTITION BY label) AS survives, vec_id FROM ({_POINTS})")
def geo16_duplicate_survivor(t: Tables):
    pts = _points(t).withColumns({"lon": F.col("x") / 100, "lat": F.col("y") / 100})
    return geo.duplicate_geometry(pts, ["label"], "vec_id", "lon", "lat").select("label", "survives", "vec_id")


@query("geo10_ring_faults", """
SELECT CASE r_regionkey WHEN 0 THEN 'too_few_points' WHEN 1 THEN 'not_closed' WHEN 2 THEN 'no_area' END AS fault, CASE WHEN r_regionkey = 1 THEN NULL WHEN r_regionkey = 0 THEN 'too_few_points' WHEN r_regionkey = 2 THEN 'no_area' END AS after FROM region""")
def geo10_ring_faults(t: Tables):
    k = F.col("r_regionkey")
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    good = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1), p(0, 0))
    ring = F.when(k == 0, F.array(p(0, 0), p(1, 0))).when(k == 1, F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))).when(k == 2, F.array(p(0, 0), p(1, 0), p(2, 0), p(0, 0))).otherwise(good)
    rows = t.region.select(ring.alias("ring"))
    return rows.select(geo.ring_fault("ring").alias("fault"), F.when(F.size("ring") > 2, geo.ring_fault(geo.repaired_ring("ring"))).otherwise(geo.ring_fault("ring")).alias("after"))


#: Three-point lines: the middle point stays where it lies off the line of the ends.
_LINES = f"SELECT c_custkey, lon AS x0, lat AS y0, lon + 1.0 AS x1, lat + (c_custkey % 7) / 8.0 AS y1, lon + 2.0 AS x2, lat + 0.25 AS y2 FROM ({_LONLAT})"


@query("geo12_simplified", f"""
SELECT c_custkey, CASE WHEN abs((x2 - x0) * (y0 - y1) - (x0 - x1) * (y2 - y0)) / sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) > 0.15 THEN 3 ELSE 2 END AS n_points FROM ({_LINES})""")
def geo12_simplified(t: Tables):
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    line = F.array(p(0.0, F.lit(0.0)), p(1.0, (F.col("c_custkey") % 7) / 8.0), p(2.0, F.lit(0.25)))
    return _lonlat(t).select("c_custkey", F.size(geo.simplify(line, 0.15)).alias("n_points"))


@query("geo15_datum_residuals", f"""
WITH p AS (SELECT c_nationkey, c_custkey % 5 AS k FROM ({_LONLAT}))
SELECT c_nationkey, count(*) FILTER (k = 0) AS unconverted, count(*) FILTER (k > 0) AS n, (avg(CASE WHEN k > 0 THEN CASE WHEN k < 3 THEN 1.0 ELSE 0.0 END END) * 1000)::INTEGER AS within FROM p GROUP BY 1""")
def geo15_datum_residuals(t: Tables):
    k = F.col("c_custkey") % 5
    # one degree of latitude is some 111 km: k = 1, 2 lie within a metre, 3 and 4 do not, 0 was never moved
    rows = _lonlat(t).select(
        "c_nationkey", F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("lon").alias("x1"), (F.col("lat") + 0.001 + k * 4e-6).alias("y1"),
        F.col("lon").alias("x2"), F.when(k == 0, F.col("lat")).otherwise(F.col("lat") + 0.001).alias("y2"),
    )
    found = geo.datum_residuals(rows, ["c_nationkey"], ("x1", "y1"), ("x2", "y2"), unmoved=("x0", "y0"))
    return found.select("c_nationkey", "unconverted", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.col("within_1m") * 1000).cast("int").alias("within"))

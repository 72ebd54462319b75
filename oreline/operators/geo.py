"""Points, lines and polygons as columns: distances, projections, grids, tiles.

Geometry is an array of ``struct<x, y>`` (longitude, latitude) or a pair of
columns. Joins on distance and containment go through grid cells, so they are
equi joins with an exact test behind them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.aggregates import ranked_percentiles
from oreline.operators.graph import connected_components
from oreline.operators.windows import joined_back

EARTH_M = 6371008.8
# Fixed values of the ellipsoid WGS 84.
_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)


def haversine_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    dy, dx = F.radians(y2 - y1) / 2, F.radians(x2 - x1) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dx), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def ellipsoidal_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres on the ellipsoid for short legs: local radii at the mean latitude."""
    mean = F.radians((y1 + y2) / 2)
    w = 1 - _E2 * F.pow(F.sin(mean), 2)
    north = F.radians(y2 - y1) * _A * (1 - _E2) / F.pow(w, 1.5)
    east = F.radians(x2 - x1) * F.cos(mean) * _A / F.sqrt(w)
    return F.sqrt(north * north + east * east)


def path_length(points: str | Column, leg=haversine_m) -> Column:
    """Sum of the legs of a line."""
    p = F.col(points) if isinstance(points, str) else points
    tail = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    head = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    legs = F.zip_with(head, tail, lambda a, b: leg(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, d: acc + d)


def midpoint(points: str | Column) -> Column:
    """The point halfway along a line (planar legs)."""
    p = F.col(points) if isinstance(points, str) else points
    half = path_length(p, planar) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(p, 1)["x"].alias("px"), F.element_at(p, 1)["y"].alias("py"), F.lit(None).cast("double").alias("mx"), F.lit(None).cast("double").alias("my"))

    def step(acc: Column, q: Column) -> Column:
        d = planar(acc["px"], acc["py"], q["x"], q["y"])
        inside = acc["mx"].isNull() & (acc["done"] + d >= half)
        t = F.when(d > 0, (half - acc["done"]) / d).otherwise(0.0)
        return F.struct(
            (acc["done"] + d).alias("done"), q["x"].alias("px"), q["y"].alias("py"),
            F.when(inside, acc["px"] + t * (q["x"] - acc["px"])).otherwise(acc["mx"]).alias("mx"),
            F.when(inside, acc["py"] + t * (q["y"] - acc["py"])).otherwise(acc["my"]).alias("my"),
        )

    return F.aggregate(p, start, step, lambda acc: F.struct(acc["mx"].alias("x"), acc["my"].alias("y")))


def utm_zone_epsg(lon: Column) -> Column:
    """Northern zone of a longitude; 180 degrees belong to the last zone."""
    return (F.lit(32600) + F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))).cast("int")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _A, F.asinh(F.tan(F.radians(lat))) * _A


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Transverse Mercator of the point's own zone (series to the fourth order)."""
    zone = F.floor((lon + 180) / 6)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 177))
    k0, e4, e6, ep2 = 0.9996, _E2**2, _E2**3, _E2 / (1 - _E2)
    n = _A / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = _A * (
        (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    east = 500000 + k0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    north = k0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t) * F.pow(a, 6) / 720))
    return east, north


def _conic(lat0: float, lat1: float, lat2: float) -> tuple[float, float, float]:
    """Cone constant, c and radius at the origin of an equal-area conic."""
    e = math.sqrt(_E2)

    def q_at(s: float) -> float:
        return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_at(d: float) -> float:
        return math.cos(math.radians(d)) / math.sqrt(1 - _E2 * math.sin(math.radians(d)) ** 2)

    sines = [math.sin(math.radians(d)) for d in (lat0, lat1, lat2)]
    q0, q1, q2 = map(q_at, sines)
    m1, m2 = m_at(lat1), m_at(lat2)
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, _A * math.sqrt(c - n * q0) / n


def albers(lon: Column, lat: Column, *, lon0: float = -96.0, lat0: float = 23.0, lat1: float = 29.5, lat2: float = 45.5) -> tuple[Column, Column]:
    """Equal-area conic of the ellipsoid with two standard parallels."""
    e = math.sqrt(_E2)
    n, c, rho0 = _conic(lat0, lat1, lat2)
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = _A * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_longitude(x: Column, y: Column, *, lon0: float = -96.0, lat0: float = 23.0, lat1: float = 29.5, lat2: float = 45.5) -> Column:
    """Longitude of a point of ``albers``."""
    n, _, rho0 = _conic(lat0, lat1, lat2)
    return F.degrees(F.atan2(x, F.lit(rho0) - y)) / n + lon0


def albers_longitude_of(x: np.ndarray, y: np.ndarray, *, lon0: float = -96.0, lat0: float = 23.0, lat1: float = 29.5, lat2: float = 45.5) -> np.ndarray:
    """``albers_longitude`` of arrays."""
    n, _, rho0 = _conic(lat0, lat1, lat2)
    return np.degrees(np.arctan2(x, rho0 - y)) / n + lon0


def in_box(x: Column, y: Column, box: tuple[float, float, float, float], *, widest: float = 4.0) -> Column:
    """Bounding-box filter as plain ranges (pushed to the scan); wider boxes are refused."""
    x0, y0, x1, y1 = box
    if x1 - x0 > widest or y1 - y0 > widest:
        raise ValueError(f"box is wider than {widest} degrees")
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile that owns a point (half-open edges)."""
    size = float(1 << zoom)
    x = F.floor((lon + 180) / 360 * size)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * size)
    last = F.lit((1 << zoom) - 1).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(x, last)), F.greatest(F.lit(0).cast("long"), F.least(y, last))


def simplify_tolerance(zoom: int, span: float = 360.0) -> float:
    return span / 2**zoom / 4096 * 4


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Line with the vertices that matter at a tolerance; ends always stay."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length = math.hypot(x1 - x0, y1 - y0)
        far, at = tolerance, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(points: str | Column, tolerance: float) -> Column:
    """``simplified`` over a column of lines; a batch of lines at a time, null lines stay null."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def lines(column: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            return [{"x": x, "y": y} for x, y in simplified([(p["x"], p["y"]) for p in line], tolerance)]

        return column.map(one)

    return lines(F.col(points) if isinstance(points, str) else points)


def datum_residuals(df: DataFrame, keys: list[str], moved: tuple[str, str], published: tuple[str, str], *, unmoved: tuple[str, str], same_m: float = 0.001) -> DataFrame:
    """Residuals of transformed against published coordinates: median, p99, largest, share within a metre.

    Pairs whose published point equals the unmoved one within ``same_m`` were
    never converted and are counted apart. NAD83 and WGS84 are taken as equal.
    """
    apart = ellipsoidal_m(*(F.col(c) for c in (*moved, *published)))
    still = ellipsoidal_m(*(F.col(c) for c in (*unmoved, *published))) <= same_m
    marked = df.select(*keys, apart.alias("__m"), F.coalesce(still, F.lit(False)).alias("__still"))
    counts = marked.groupBy(*keys).agg(
        F.count_if("__still").alias("unconverted"), F.max(F.when(~F.col("__still"), F.col("__m"))).alias("largest"),
        F.avg(F.when(~F.col("__still"), (F.col("__m") <= 1.0).cast("double"))).alias("within_1m"),
    )
    ranks = ranked_percentiles(marked.where("NOT __still"), keys, "__m", {"median": (1, 2), "p99": (99, 100)}, "floor")
    return joined_back(counts, ranks, keys)


def near_pairs(df: DataFrame, key: str, x: str, y: str, radius: float, *, extra: list[str] | None = None) -> DataFrame:
    """Pairs ``a < b`` of points within a planar radius, each once.

    Points fall into square cells as wide as the radius; one side is replicated
    to the 3 x 3 cells around it, and the join is on the cell.
    """
    extra = extra or []
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y, *extra)
    cell = lambda c: F.floor(F.col(c) / radius)
    a = p.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), *[F.col(e).alias(f"a_{e}") for e in extra], cell(x).alias("cx"), cell(y).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = p.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), *[F.col(e).alias(f"b_{e}") for e in extra], around.alias("s"))
    b = b.withColumns({"cx": F.floor(F.col("bx") / radius) + F.col("s.i"), "cy": F.floor(F.col("by") / radius) + F.col("s.j")}).drop("s")
    joined = a.join(b, ["cx", "cy"]).where(F.col("a") < F.col("b"))
    distance = planar(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return joined.withColumn("distance", distance).where(F.col("distance") <= radius).drop("cx", "cy")


def neighbour_edges(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Directed edges both ways, closest geometry of each pair, rounded to the millimetre.

    Only a table in which a key has several points needs the pairs grouped.
    """
    pairs = near_pairs(df, key, x, y, radius).select("a", "b", F.round("distance", 3).alias("distance"))
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not points.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        pairs = pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    ways = F.array(F.struct("a", "b", "distance"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    return pairs.select(F.explode(ways).alias("e")).select("e.*")


#: Sub-cells on each side of a cell.
_FINER = 4


def near_links(df: DataFrame, key: str, x: str, y: str, radius: float, *, day: str | None = None, days: int = 0) -> DataFrame:
    """Links ``a, b`` with the components of all pairs within a radius (and a day gap).

    Cells are so narrow that all points of one are near each other, so a point is
    linked to its sub-cell and a sub-cell to its cell, by their least keys,
    instead of to every neighbour. Two cells are linked where the boxes of two of
    their sub-cells lie wholly within the radius. Only between cells that no such
    pair links are points compared, and only those of sub-cells whose boxes are
    neither wholly near nor wholly far. So a dense cell costs its points, not
    their pairs.
    """
    side, span = radius / math.sqrt(2) * (1 - 1e-9), days + 1
    number = F.datediff(day, F.lit("1970-01-01").cast("date")) if day else F.lit(0)
    points = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), number.alias("d")).dropna()
    fine = [F.floor(F.col("x") / side * _FINER).alias("fx"), F.floor(F.col("y") / side * _FINER).alias("fy"), F.floor(F.col("d") / span * _FINER).alias("fd")]
    points = points.select("*", *fine)
    coarse = [F.floor(F.col(f"f{c}") / _FINER).alias(f"c{c}") for c in "xyd"]
    ends = [f(c).alias(f"{n}_{c}") for c in "xyd" for n, f in (("low", F.min), ("high", F.max))]
    subs = points.groupBy("fx", "fy", "fd").agg(F.min("key").alias("least"), *ends).select("*", *coarse)
    cells = subs.groupBy("cx", "cy", "cd").agg(F.min("least").alias("cell"))
    inside = points.join(subs.select("fx", "fy", "fd", "least"), ["fx", "fy", "fd"]).select(F.col("key").alias("a"), F.col("least").alias("b"))
    inside = inside.union(subs.join(cells, ["cx", "cy", "cd"]).select(F.col("least").alias("a"), F.col("cell").alias("b"))).where("a <> b")

    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in ((-1, 0, 1) if day else (0,)) if (i, j, k) > (0, 0, 0)]
    step = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, "ijk"))) for t in steps)))
    one = subs.select(*(F.col(c).alias(f"a_{c}") for c in subs.columns), step.alias("s"))
    one = one.select("*", (F.col("a_cx") + F.col("s.i")).alias("cx"), (F.col("a_cy") + F.col("s.j")).alias("cy"), (F.col("a_cd") + F.col("s.k")).alias("cd")).drop("s")
    boxes = one.join(subs, ["cx", "cy", "cd"])

    def farthest(c: str) -> Column:
        return F.greatest(F.abs(F.col(f"high_{c}") - F.col(f"a_low_{c}")), F.abs(F.col(f"a_high_{c}") - F.col(f"low_{c}")))

    def nearest(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"a_high_{c}"), F.col(f"a_low_{c}") - F.col(f"high_{c}"))

    far = farthest("x") * farthest("x") + farthest("y") * farthest("y")
    near = nearest("x") * nearest("x") + nearest("y") * nearest("y")
    whole = (far <= radius * radius * (1 - 1e-9)) & (farthest("d") <= days)
    maybe = (near <= radius * radius * (1 + 1e-9)) & (nearest("d") <= days)
    boxes = boxes.withColumn("whole", whole).where(F.col("whole") | maybe)
    pair = ["a_cx", "a_cy", "a_cd", "cx", "cy", "cd"]
    across = boxes.where("whole").groupBy(*pair).agg(F.min(F.struct("a_least", "least")).alias("l")).select(*pair, F.col("l.a_least").alias("a"), F.col("l.least").alias("b"))
    unsure = boxes.where("NOT whole").join(across.select(*pair), pair, "left_anti").select("a_fx", "a_fy", "a_fd", "fx", "fy", "fd")
    left = points.select(F.col("key").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("d").alias("ad"), *(F.col(f"f{c}").alias(f"a_f{c}") for c in "xyd"))
    both = unsure.join(left, ["a_fx", "a_fy", "a_fd"]).join(points, ["fx", "fy", "fd"])
    close = (planar(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) <= radius) & (F.abs(F.col("ad") - F.col("d")) <= days)
    return inside.union(across.select("a", "b")).union(both.where(close).select("a", F.col("key").alias("b")))


def pad_groups(df: DataFrame, key: str, x: str, y: str, day: str, radius: float, days: int) -> DataFrame:
    """Single-linkage groups by distance and day gap: ``key, group`` with the least key as group."""
    groups = connected_components(near_links(df, key, x, y, radius, day=day, days=days), "a", "b")
    return df.select(key).join(groups, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", F.col(key)).alias("group"))


def dbscan_pairs(df: DataFrame, key: str, x: str, y: str, eps: float) -> DataFrame:
    """Density clusters with two points at least: single linkage, lone points without a cluster."""
    return connected_components(near_links(df, key, x, y, eps), "a", "b").select(F.col("node").alias(key), F.col("component").alias("cluster"))


def inside_ring(x: Column, y: Column, ring: str | Column) -> Column:
    """Ray casting: whether a closed ring (first point repeated last) holds the point."""
    r = F.col(ring) if isinstance(ring, str) else ring
    head, tail = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    crossed = F.zip_with(
        head, tail,
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda acc, c: acc + c) % 2 == 1


def ring_area(ring: str | Column) -> Column:
    r = F.col(ring) if isinstance(ring, str) else ring
    head, tail = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return F.abs(F.aggregate(F.zip_with(head, tail, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)) / 2


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, cell: float) -> DataFrame:
    """Point-in-polygon join through the grid cells that a polygon's box touches."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    cells = polygons.withColumn("__cx", F.explode(span(xs))).withColumn("__cy", F.explode(span(ys)))
    placed = points.withColumns({"__cx": F.floor(F.col(x) / cell), "__cy": F.floor(F.col(y) / cell)})
    return placed.join(cells, ["__cx", "__cy"]).where(inside_ring(F.col(x), F.col(y), ring)).drop("__cx", "__cy")


def smallest_container(points: DataFrame, polygons: DataFrame, point_key: str, x: str, y: str, polygon_key: str, ring: str, cell: float) -> DataFrame:
    """Smallest polygon around each point, how many overlap there, and all of their keys."""
    held = points_in_polygons(points, polygons, x, y, ring, cell).withColumn("__area", ring_area(ring))
    w = Window.partitionBy(point_key)
    ranked = held.withColumns({"__r": F.row_number().over(w.orderBy("__area", polygon_key)), "n_overlaps": F.count("*").over(w), "all_keys": F.array_sort(F.collect_set(polygon_key).over(w))})
    found = ranked.where("__r = 1").select(point_key, F.col(polygon_key).alias("container"), "n_overlaps", "all_keys")
    return points.select(point_key).join(found, point_key, "left")


def outside_domain(df: DataFrame, group: str, points: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Geometries with a vertex outside the supported domain, counted by group."""
    x0, y0, x1, y1 = box
    out = F.exists(points, lambda p: (p["x"] < x0) | (p["x"] > x1) | (p["y"] < y0) | (p["y"] > y1))
    return df.where(out).groupBy(group).agg(F.count("*").alias("n"))


def duplicate_geometry(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """All geometries of a key with their distance from the one that stays, the first by ``order``.

    ``order`` is a full order of a key's rows; the survivor is an aggregate joined
    back, so a key with many geometries is spread.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("__first"))
    both = joined_back(df, first, keys)
    apart = haversine_m(F.col(x), F.col(y), F.col("__first.x"), F.col("__first.y"))
    return both.withColumns({"metres_from_survivor": apart, "survives": F.col(order).eqNullSafe(F.col("__first.at"))}).drop("__first")


def ring_fault(ring: str | Column) -> Column:
    """Why a ring can't be used: too few points, open, or without area; null if it can."""
    r = F.col(ring) if isinstance(ring, str) else ring
    first, last = F.element_at(r, 1), F.try_element_at(r, F.size(r))
    return F.when(r.isNull() | (F.size(r) < 4), "too_few_points").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not_closed").when(ring_area(r) == 0, "no_area")


def repaired_ring(ring: str | Column) -> Column:
    """Close an open ring and drop repeated neighbours; area faults stay."""
    r = F.col(ring) if isinstance(ring, str) else ring
    closed = F.when((F.element_at(r, 1)["x"] != F.try_element_at(r, F.size(r))["x"]) | (F.element_at(r, 1)["y"] != F.try_element_at(r, F.size(r))["y"]), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    return F.filter(closed, lambda p, i: (i == 0) | (p != F.try_element_at(closed, i.cast("int"))))

"""Polygons of any size, with parts and holes: faults, repair, cover and containment.

A polygon is an array of rings (arrays of ``struct<x, y>``), all parts and holes
alike; a point is inside where it is inside an odd number of rings. What is
costly runs over rows of edges: edges meet in the grid cells that they pass, a
cover follows the boundary and fills the inside with ever larger cells, and a
point is tested against the edges of its own cell only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.operators.geo import tile_of
from oreline.operators.lines import by_number, flat_points, legs, with_cells
from oreline.operators.windows import joined_back
from oreline.storage import written

#: Where in a row of cells its crossings are taken; any place serves, a vertex there is unlikely.
_AT = 0.3819660112501051


def edges(df: DataFrame, key: str, rings: str) -> DataFrame:
    """``key, ring, leg, x0, y0, x1, y1`` of all rings; an open ring is closed by an edge of its own."""
    each = df.select(key, F.posexplode(rings).alias("ring", "points")).where(F.size("points") > 1)
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    closed = F.when((first["x"] != last["x"]) | (first["y"] != last["y"]), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    return legs(each.withColumn("points", closed), "points", key, "ring").where("x0 <> x1 OR y0 <> y1")


def _divided(own: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Where pairs of edges ``x0, y0, x1, y1`` must be divided: which of the two (0, 1), for which pairs, and at what points.

    Edges on each other have no point.
    """
    (ax, ay, bx, by), (cx, cy, dx, dy) = own, other
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)

    def on(px, py, ux, uy, vx, vy, straight) -> np.ndarray:
        """Which ends ``p`` lie on the edge ``u v``, its own ends left out."""
        inside = (px >= np.minimum(ux, vx)) & (px <= np.maximum(ux, vx)) & (py >= np.minimum(uy, vy)) & (py <= np.maximum(uy, vy))
        return (straight == 0) & inside & ((px != ux) | (py != uy)) & ((px != vx) | (py != vy))

    crossing = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
    t = s3 / np.where(s3 == s4, 1.0, s3 - s4)
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    same = (ax == cx) & (ay == cy) & (bx == dx) & (by == dy) | (ax == dx) & (ay == dy) & (bx == cx) & (by == cy)
    return [
        (0, crossing, x, y), (1, crossing, x, y), (0, on(cx, cy, ax, ay, bx, by, s1), cx, cy), (0, on(dx, dy, ax, ay, bx, by, s2), dx, dy),
        (1, on(ax, ay, cx, cy, dx, dy, s3), ax, ay), (1, on(bx, by, cx, cy, dx, dy, s4), bx, by), (0, same, None, None),
    ]


def _meetings(segments: DataFrame, key: str, cell: float) -> DataFrame:
    """Points at which an edge must be divided: ``key, ring, leg, x, y``, each once.

    Edges of one polygon meet by the cells they pass, in a sort-merge join:
    edges of like polygons compress to a small part of what they take in
    memory, so that a broadcast of them is sized wrong. Where two cross, both
    are divided at the crossing; where an end, or an overlap, lies on another
    edge, that one is. Pairs are tested a batch at a time.
    """
    names = ("ring", "leg", "x0", "y0", "x1", "y1")
    cells = with_cells(segments, cell)
    own, other = (cells.select(F.col(key).alias(f"{side}_key"), F.col("cx").alias(f"{side}_cx"), F.col("cy").alias(f"{side}_cy"), *(F.col(n).alias(f"{side}_{n}") for n in names)) for side in ("a", "b"))
    one_cell = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("key", "cx", "cy")]
    met = own.join(other.hint("merge"), one_cell).where(F.struct("a_ring", "a_leg") < F.struct("b_ring", "b_leg"))
    rows = met.select(F.col("a_key").alias(key), *(F.col(f"{side}_{n}") for n in names for side in "ab"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [tuple(batch.column(i + side).to_numpy(zero_copy_only=False) for i in (5, 7, 9, 11)) for side in (0, 1)]
            found = []
            for side, mark, x, y in _divided(*ends):
                at = np.flatnonzero(mark)
                if len(at):
                    point = [pa.nulls(len(at), pa.float64()) if v is None else pa.array(v[at]) for v in (x, y)]
                    found.append([*(batch.column(i).take(pa.array(at)) for i in (0, 1 + side, 3 + side)), *point])
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], [key, "ring", "leg", "x", "y"])

    kept = segments.select(key, "ring", "leg").schema.fields
    return rows.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in "xy")])).distinct()


def faults(df: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``key, reason, n_crossings``: why a polygon can't be used as it stands; reason null if it can.

    The first that holds: ``empty`` (no ring), ``too_few_points``,
    ``not_closed``, ``self_crossing`` (rings cross, touch an edge with a corner,
    or lie on each other), ``no_area`` (some ring). ``n_crossings`` counts the
    places at which edges would have to be divided. Edges are written once: they
    meet themselves, and the plan does not repeat what ``rings`` is made from.
    """

    def ends_apart(r: Column) -> Column:
        first, last = F.element_at(r, 1), F.element_at(r, -1)
        return (first["x"] != last["x"]) | (first["y"] != last["y"])

    found = F.coalesce(rings, F.array().cast(df.schema[rings].dataType))
    per = (
        F.when(F.size(found) == 0, "empty")
        .when(F.exists(found, lambda r: F.size(r) < 4), "too_few_points")
        .when(F.exists(found, ends_apart), "not_closed")
    )
    no_area = F.when(F.exists(found, lambda r: signed_area(r) == 0), "no_area")
    places = _meetings(written(edges(df, key, rings), "polygon-edges"), key, cell).select(key, "x", "y").distinct().groupBy(key).agg(F.count("*").alias("n_crossings"))
    n = F.coalesce("n_crossings", F.lit(0).cast("long"))
    judged = df.select(key, per.alias("reason"), no_area.alias("__flat")).join(places.hint("merge"), key, "left")
    return judged.select(key, F.coalesce("reason", F.when(n > 0, "self_crossing"), "__flat").alias("reason"), n.alias("n_crossings"))


def signed_area(ring: str | Column) -> Column:
    """Area of a closed ring, positive if it runs anticlockwise."""
    r = F.col(ring) if isinstance(ring, str) else ring
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v) / 2


def _odd_right(px: np.ndarray, py: np.ndarray, own: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Whether an odd number of edges, the own one apart, lies to the right of each point."""
    odd = np.zeros(len(px), bool)
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    order = np.argsort(py, kind="stable")
    for at in range(0, len(order), 256):  # neighbours in height share the edges that reach them
        some = order[at : at + 256]
        near = np.flatnonzero((low <= py[some].max()) & (high > py[some].min()))
        a, b, y = y0[near][None], y1[near][None], py[some][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = (x1[near] - x0[near])[None] * (y - a) / (b - a) + x0[near][None]
        odd[some] = (((a > y) != (b > y)) & (cross > px[some][:, None]) & (near[None] != own[some][:, None])).sum(axis=1) % 2 == 1
    return odd


def traced(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings, inside to the left, of edges that only meet at their ends and each bound the inside.

    At a corner with several ways on, the leftmost is taken, so rings touch
    each other and themselves nowhere but in corners.
    """
    n = len(x0)
    own, flat = np.arange(n), y0 == y1
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    right_in = np.zeros(n, bool)
    right_in[~flat] = _odd_right(mx[~flat], my[~flat], own[~flat], x0, y0, x1, y1)
    above_in = np.zeros(n, bool)
    above_in[flat] = _odd_right(my[flat], mx[flat], own[flat], y0, x0, y1, x1)
    forward = np.where(flat, above_in == (x1 > x0), right_in == (y1 < y0))
    ax, ay, bx, by = (np.where(forward, a, b) for a, b in ((x0, x1), (y0, y1), (x1, x0), (y1, y0)))
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, corner in enumerate(zip(ax.tolist(), ay.tolist())):
        leaving.setdefault(corner, []).append(i)
    rings, used = [], np.zeros(n, bool)
    for start in range(n):
        ring, at = [], start
        while not used[at]:
            used[at] = True
            ring.append((float(ax[at]), float(ay[at])))
            corner = (float(bx[at]), float(by[at]))
            ways = [i for i in leaving[corner] if not used[i]]
            if not ways:
                break
            back = math.atan2(ay[at] - by[at], ax[at] - bx[at])
            turn = lambda i: (back - math.atan2(by[i] - ay[i], bx[i] - ax[i])) % (2 * math.pi) or 2 * math.pi
            at = min(ways, key=turn)
        if len(ring) > 2:
            rings.append([*ring, ring[0]])
    return rings


_RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


@F.pandas_udf(T.StructType([T.StructField("rings", _RINGS), T.StructField("area", T.DoubleType())]))
def _traced(bundles: pd.Series) -> pd.DataFrame:
    """Rings and area of each polygon's pieces."""
    rows = []
    for bundle in bundles:
        found = traced(*(np.array([e[c] for e in bundle], float) for c in ("x0", "y0", "x1", "y1")))
        area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) for r in found) / 2
        rows.append(([[{"x": x, "y": y} for x, y in r] for r in found], area))
    return pd.DataFrame(rows, columns=["rings", "area"])


def repaired(df: DataFrame, key: str, rings: str, cell: float, *, digits: int = 9) -> DataFrame:
    """``key, rings, area``: the same inside as before by the even-odd rule, with rings that do not cross.

    Edges are divided where they meet, pieces that lie on each other an even
    number of times bound nothing and go, and the rest is traced into closed
    rings, anticlockwise around the inside and clockwise around holes. Corners
    are rounded to ``digits`` decimals. Polygons without inside have no rings.
    Dividing is a join over cells; one polygon's pieces are then traced together.
    Edges and rings are written once, since both are read several times.
    """
    round_to = lambda c: F.rint(F.col(c) * 10.0**digits) / 10.0**digits
    rounded = edges(df, key, rings).withColumns({c: round_to(c) for c in ("x0", "y0", "x1", "y1")})
    segments = written(rounded.where("x0 <> x1 OR y0 <> y1"), "polygon-edges")
    met = _meetings(segments, key, cell).where("x IS NOT NULL").withColumns({"x": round_to("x"), "y": round_to("y")})
    stops = met.groupBy(key, "ring", "leg").agg(F.collect_set(F.struct("x", "y")).alias("stops"))
    along = lambda p: (p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    middle = F.transform(F.array_sort(F.transform("stops", lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda s: s["p"])
    whole = F.concat(F.array(corner("x0", "y0")), F.coalesce(middle, F.array()), F.array(corner("x1", "y1")))
    pieces = legs(segments.join(stops.hint("merge"), [key, "ring", "leg"], "left").select(key, whole.alias("w")), "w", key).where("x0 <> x1 OR y0 <> y1")
    turned = F.struct("x1", "y1") < F.struct("x0", "y0")
    same_way = pieces.select(key, *(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))))
    odd = same_way.groupBy(key, "x0", "y0", "x1", "y1").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")

    bundled = odd.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("e"))
    traced_ = written(bundled.select(key, _traced("e").alias("r")), "polygon-rings")
    none = F.array().cast(_RINGS)
    return df.select(key).join(traced_.hint("merge"), key, "left").select(key, F.coalesce("r.rings", none).alias("rings"), F.coalesce("r.area", F.lit(0.0)).alias("area"))


def cover(polygons: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """Cells that a polygon touches: ``key, level, cx, cy, edges, inside``.

    Cells of level l are ``cell * 2^l`` wide. Those of level 0 hold the edges
    that pass them and whether the start of their middle row is inside; the
    others lie wholly inside (``edges`` null), each as large as the boundary
    allows. So the cover grows with the length of the boundary, not with the
    area: every cell of it is a boundary cell or next to one of its level.
    """
    placed = with_cells(edges(polygons, key, rings), cell).select(key, "cx", "cy", "x0", "y0", "x1", "y1")
    border = placed.groupBy(key, "cx", "cy").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    # Enough levels for the top cells to be as wide as the widest polygon.
    widest = placed.groupBy(key).agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("w")).agg(F.max("w")).first()[0]
    top = int(widest or 0).bit_length() + 1
    up = F.explode(F.sequence(F.lit(0), F.lit(top)))
    touched = border.select(key, "cx", "cy", up.alias("level")).select(key, "level", F.expr("shiftright(cx, level)").alias("cx"), F.expr("shiftright(cy, level)").alias("cy")).distinct()
    quarter = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    below = touched.where("level > 0").withColumn("q", quarter).select(key, (F.col("level") - 1).alias("level"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"))
    whole = below.join(touched, [key, "level", "cx", "cy"], "left_anti")
    asked = whole.select(key, "level", "cx", "cy", F.expr("shiftleft(cy, level)").alias("row")).union(border.select(key, F.lit(0).alias("level"), "cx", "cy", F.col("cy").alias("row")))
    # Inside or outside at the start of a cell: crossings of its row to the left of it, counted along the row.
    rows = edges(polygons, key, rings).withColumn("row", F.explode(F.sequence(F.floor(F.least("y0", "y1") / cell), F.floor(F.greatest("y0", "y1") / cell))))
    height = (F.col("row") + _AT) * cell
    crossing = (F.col("x1") - F.col("x0")) * (height - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    events = rows.where((F.col("y0") > height) != (F.col("y1") > height)).select(key, "row", crossing.alias("x"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("cx"), F.lit(None).cast("long").alias("cy"))
    starts = asked.select(key, "row", (F.expr("shiftleft(cx, level)") * cell).alias("x"), F.lit(0).alias("n"), "level", "cx", "cy")
    run = Window.partitionBy(key, "row").orderBy("x", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = events.union(starts).withColumn("inside", F.sum("n").over(run) % 2 == 1).where("n = 0").select(key, "level", "cx", "cy", "inside")
    return known.join(border.withColumn("level", F.lit(0)), [key, "level", "cx", "cy"], "left").where("edges IS NOT NULL OR inside")


def points_in(points: DataFrame, x: str, y: str, covered: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows of ``points`` with the ``key`` of every polygon that holds them; points in none are left out.

    ``covered`` is a ``cover`` with the same cell. A point looks its cell up at
    each level that the cover has (a few numbers). In a cell of the boundary it
    is reached from the start of the middle row, along the row and then up or
    down, and each of the cell's edges on the way changes sides.
    """
    levels = sorted(r[0] for r in covered.select("level").distinct().collect())
    at = [F.struct(F.lit(level).alias("level"), F.shiftright(F.floor(F.col(x) / cell), level).alias("cx"), F.shiftright(F.floor(F.col(y) / cell), level).alias("cy")) for level in levels]
    if not at:
        return points.join(covered.select(key), F.lit(False))
    placed = points.withColumn("__at", F.explode(F.array(*at)))
    named = covered.select(key, *(F.col(c).alias(f"__{c}") for c in ("level", "cx", "cy", "edges", "inside")))
    met = placed.join(named, (F.col("__at.level") == F.col("__level")) & (F.col("__at.cx") == F.col("__cx")) & (F.col("__at.cy") == F.col("__cy")))
    px, py = F.col(x), F.col(y)
    height, start = (F.col("__cy") + _AT) * cell, F.col("__cx") * cell

    def changes(e: Column) -> Column:
        over = (e["x1"] - e["x0"]) * (height - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]
        up = (e["y1"] - e["y0"]) * (px - e["x0"]) / F.nullif(e["x1"] - e["x0"], F.lit(0.0)) + e["y0"]
        along = ((e["y0"] > height) != (e["y1"] > height)) & (over >= start) & (over < px)
        across = ((e["x0"] > px) != (e["x1"] > px)) & (up >= F.least(height, py)) & (up < F.greatest(height, py))
        return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(across, F.lit(False)).cast("int")

    n = F.aggregate(F.coalesce("__edges", F.array()), F.lit(0), lambda acc, e: acc + changes(e))
    return met.where(F.when(F.col("__edges").isNull(), F.lit(True)).otherwise((F.col("__inside").cast("int") + n) % 2 == 1)).select(*points.columns, key)


def containers(points: DataFrame, point_key: str, x: str, y: str, polygons: DataFrame, key: str, rings: str, area: str, cell: float) -> DataFrame:
    """Smallest polygon around each point, how many overlap there, and all of their keys.

    ``area`` is a column of ``polygons``; equal areas go by key. Points in no
    polygon have null, null, null. Reduced by aggregates, so a point with many
    polygons is one row early.
    """
    held = points_in(points.select(point_key, x, y), x, y, cover(polygons, key, rings, cell), key, cell)
    sized = held.join(polygons.select(key, area), key)
    found = sized.groupBy(point_key).agg(F.min(F.struct(F.col(area).alias("a"), F.col(key).alias("k"))).alias("m"), F.count("*").alias("n_overlaps"), F.array_sort(F.collect_set(key)).alias("all_keys"))
    return joined_back(points.select(point_key), found.select(point_key, F.col("m.k").alias("container"), "n_overlaps", "all_keys"), [point_key])


def inner_point(rings: list[list[tuple[float, float]]]) -> tuple[float, float] | None:
    """A point inside a polygon: the middle of the widest stretch that a scan line has inside.

    The line runs at the middle of the box, moved half way to the next corner
    above if one lies on it. None if no stretch has width (no area there).
    """
    corners = [p for r in rings for p in r]
    if not corners:
        return None
    ys = sorted({p[1] for p in corners})
    middle = (ys[0] + ys[-1]) / 2
    above = [y for y in ys if y > middle]
    height = middle if middle not in ys or not above else (middle + above[0]) / 2
    crossings = []
    for r in rings:
        closed = r if r[0] == r[-1] else [*r, r[0]]
        for (ax, ay), (bx, by) in zip(closed, closed[1:]):
            if (ay > height) != (by > height):
                crossings.append((bx - ax) * (height - ay) / (by - ay) + ax)
    crossings.sort()
    width, at = max(((b - a, -a) for a, b in zip(crossings[::2], crossings[1::2])), default=(0.0, 0.0))
    return (-at + width / 2, height) if width > 0 else None


def label_anchors(polygons_: DataFrame, key: str, rings: str, zoom: int) -> DataFrame:
    """``key, x, y, tile_x, tile_y``: a point inside each polygon (longitude, latitude) and the one tile that owns it.

    The point lies inside for concave rings, parts and holes alike; tiles own
    their left and upper edges. Null for polygons without inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inner_point(by_number(points)) if points is not None else None for points in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f and f[i] for f in found], pa.float64()) for i in (0, 1))], ["k", "x", "y"])

    kind = polygons_.schema[key].dataType.simpleString()
    found = polygons_.select(key, flat_points(rings).alias("p")).mapInArrow(run, f"k {kind}, x double, y double")
    tx, ty = tile_of(F.col("x"), F.col("y"), zoom)
    return found.select(F.col("k").alias(key), "x", "y", F.when(F.col("x").isNotNull(), tx).alias("tile_x"), F.when(F.col("x").isNotNull(), ty).alias("tile_y"))

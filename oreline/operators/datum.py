"""Datum shifts by grid: nodes as rows, cells by join, bilinear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of the inverse; shifts change by far less than a tenth of themselves over their own length.
_ROUNDS = 4


def read_grid(spark: SparkSession, path: str, step: float) -> DataFrame:
    """Nodes of a shift grid, ``gx, gy, dx, dy``, from text rows ``lon, lat, dlon_seconds, dlat_seconds``.

    Nodes stand at multiples of ``step`` degrees; rows between nodes, and rows
    that can't be read, are refused when the grid is used, as their cells are
    incomplete. Blank lines and lines that start with # are skipped.
    """
    raw = spark.read.schema("lon double, lat double, e double, n double").option("comment", "#").csv(path)
    node = lambda c: F.round(F.col(c) / step).cast("long")
    exact = (F.abs(F.col("lon") / step - node("lon")) < 1e-6) & (F.abs(F.col("lat") / step - node("lat")) < 1e-6)
    return raw.where(exact).select(node("lon").alias("gx"), node("lat").alias("gy"), (F.col("e") / 3600).alias("dx"), (F.col("n") / 3600).alias("dy"))


def cells(grid: DataFrame) -> DataFrame:
    """Cells with their four corners' shifts, ``cx, cy`` and ``dx00`` to ``dy11``; incomplete ones are left out.

    A node that is given twice with different shifts makes its cells incomplete.
    """
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    nodes = grid.groupBy("gx", "gy").agg(F.min(F.struct("dx", "dy")).alias("low"), F.max(F.struct("dx", "dy")).alias("high")).where("low = high AND low.dx IS NOT NULL AND low.dy IS NOT NULL")
    part = nodes.select("gx", "gy", F.col("low.dx").alias("dx"), F.col("low.dy").alias("dy"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in corners))).alias("c"))
    placed = part.select((F.col("gx") - F.col("c.i")).alias("cx"), (F.col("gy") - F.col("c.j")).alias("cy"), "c.i", "c.j", "dx", "dy")
    at = lambda d, i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(d))).alias(f"{d}{i}{j}")
    return placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), *(at(d, i, j) for d in ("dx", "dy") for i, j in corners)).where("n = 4").drop("n")


def _bilinear(d: str, u: Column, v: Column) -> Column:
    return F.col(f"{d}00") * (1 - u) * (1 - v) + F.col(f"{d}10") * u * (1 - v) + F.col(f"{d}01") * (1 - u) * v + F.col(f"{d}11") * u * v


def shifted(df: DataFrame, x: str, y: str, grid: DataFrame, step: float, *, inverse: bool = False, out: tuple[str, str] = ("x_shifted", "y_shifted"), fact: str = "datum_fact") -> DataFrame:
    """``df`` with its points moved by a shift grid.

    ``grid`` has ``gx, gy, dx, dy``: nodes in steps and shifts in degrees. The
    inverse finds the point that the grid moves to the given one, in a few
    rounds that each look the cell up again, so it may cross cells. ``fact`` is
    ``shifted``, ``datum_undetermined`` outside complete cells (lower and left
    edges belong to a cell), or ``no_geometry``; then the point is null. Points
    are joined to cells by number; whether the cells are broadcast is left to
    their size.
    """
    table = cells(grid)
    names = {c: f"__{c}" for c in df.columns}
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    rows = rows.withColumns({"qx": F.col("px"), "qy": F.col("py")})
    for _ in range(_ROUNDS if inverse else 1):
        placed = rows.withColumns({"cx": F.floor(F.col("qx") / step), "cy": F.floor(F.col("qy") / step)})
        met = placed.join(table, ["cx", "cy"], "left")
        u, v = F.col("qx") / step - F.col("cx"), F.col("qy") / step - F.col("cy")
        sign = -1 if inverse else 1
        rows = met.select("row", "px", "py", (F.col("px") + sign * _bilinear("dx", u, v)).alias("qx"), (F.col("py") + sign * _bilinear("dy", u, v)).alias("qy"))
    state = F.when(F.col("px").isNull() | F.col("py").isNull(), "no_geometry").when(F.col("qx").isNull() | F.col("qy").isNull(), "datum_undetermined").otherwise("shifted")
    keep = [c for c in names if c not in (*out, fact)]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("qx").alias(out[0]), F.col("qy").alias(out[1]), state.alias(fact))

"""Geometry as column arithmetic: projection, centroids, areas, boxes, point in polygon."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: GRS80 ellipsoid; standard parallels, origin of the equal-area conic projection (degrees).
A, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN = (-2.0, -22.0), (-54.0, -12.0)


def albers(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """x, y in metres: Albers equal-area conic."""
    e2 = 2 * FLATTENING - FLATTENING**2
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m_of = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p1, p2, p0 = (math.radians(x) for x in (*PARALLELS, ORIGIN[1]))
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(math.sin(p2)) - q_of(math.sin(p1)))
    c = m_of(p1) ** 2 + n * q_of(math.sin(p1))
    r0 = A * math.sqrt(c - n * q_of(math.sin(p0))) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    r, t = A * F.sqrt(c - n * q) / n, n * (F.radians(lon) - math.radians(ORIGIN[0]))
    return df.withColumns({"x": r * F.sin(t), "y": r0 - r * F.cos(t)})


def weighted_centroid(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """lon, lat of each group, weighted; null where the weights sum to 0."""
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in ("lon", "lat")))


def bbox(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def polygon_area(vertices: DataFrame) -> DataFrame:
    """(unit, area) of closed rings (unit, ring, i, x, y) by the shoelace sum; holes turn the other way."""
    w = Window.partitionBy("unit", "ring").orderBy("i")
    step = vertices.select("unit", (F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")).alias("s"))
    return step.groupBy("unit").agg(F.abs(F.sum("s") / 2).alias("area"))


def _edges(vertices: DataFrame) -> DataFrame:
    """unit, x1, y1, x2, y2 of rings (unit, ring, i, x, y); level edges are crossed by no ray."""
    w = Window.partitionBy("unit", "ring").orderBy("i")
    edges = vertices.select("unit", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return edges.filter("x2 is not null")


def _inside(x: str, y: str, edges: str = "edges"):
    """Whether the ray from (x, y) to the right crosses an odd number of edges; a shared end counts for one of the two edges."""

    def crossed(e):
        rise = (e["x2"] - e["x1"]) * (F.col(y) - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when((e["y1"] > F.col(y)) != (e["y2"] > F.col(y)), F.col(x) < rise).otherwise(False)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def polygon_cells(vertices: DataFrame, cell: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index of polygons in squares of side ``cell``: (border, full, rows).

    border: unit, i, j of the squares that an edge passes; full: unit, i, j of those that lie wholly inside; rows: unit, j and the array
    edges (x1, y1, x2, y2) of those edges of a unit that reach into row j, without level ones. Squares between two border squares
    of a row are all inside or all outside: a ray from the first one's middle tells which.
    """
    edges = _edges(vertices)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("j", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    # where the edge enters and leaves the row
    part = lambda y: F.when(F.col("y1") != F.col("y2"), F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    a, b = part(F.greatest(low, F.col("j") * cell)), part(F.least(high, (F.col("j") + 1) * cell))
    west, east = F.coalesce(F.least(a, b), F.least("x1", "x2")), F.coalesce(F.greatest(a, b), F.greatest("x1", "x2"))
    slack = 1e-9 * cell
    border = rows.select("unit", "j", F.explode(F.sequence(F.floor((west - slack) / cell), F.floor((east + slack) / cell))).alias("i")).distinct()
    gap = border.withColumn("next", F.lead("i").over(Window.partitionBy("unit", "j").orderBy("i"))).filter("next > i + 1")
    gap = gap.select("unit", "j", (F.col("i") + 1).alias("first"), (F.col("next") - 1).alias("last"), ((F.col("i") + 1.5) * cell).alias("x"), ((F.col("j") + 0.5) * cell).alias("y"))
    held = rows.filter("y1 <> y2").groupBy("unit", "j").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    full = gap.join(held, ["unit", "j"]).filter(_inside("x", "y")).select("unit", F.explode(F.sequence("first", "last")).alias("i"), "j")
    return border.select("unit", "i", "j"), full, held


def points_in_polygons(points: DataFrame, vertices: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point, unit) of points (point, x, y): inside by parity, so holes are outside and islands inside.

    A point in a square that lies wholly in a unit is answered by the square. In a square on the unit's border it is cast
    against the unit's own edges of its row, held as one array, so points are read once and no pair of point and edge is
    made or grouped. Repeated points have a row each; points without both coordinates have none.
    """
    border, full, rows = polygon_cells(vertices, cell)
    placed = points.select("point", "x", "y", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"))
    squares = full.select("unit", "i", "j", F.lit(True).alias("whole")).unionByName(border.select("unit", "i", "j", F.lit(False).alias("whole")))
    return placed.join(squares, ["i", "j"]).join(rows, ["unit", "j"], "left").filter(F.col("whole") | _inside("x", "y")).select("point", "unit")

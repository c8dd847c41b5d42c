"""Ranks, nearest targets, points in polygons and observed checks against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from odflow.operators import geo, measures, ranks
from odflow.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_a_whole_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 5.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    got = ranks.numbered(df, [F.desc_nulls_last("v"), F.col("id")], start=0)
    assert "Window" not in plan_of(got)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["position"]) for r in got.orderBy("position").collect()] == [(i, k) for k, (i, _) in enumerate(want)]
    assert ranks.numbered(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("values", [[3.0, 1.0, 1.0, 1.0, 9.0, None], [5.0] * 40, list(map(float, range(300))), []])
def test_values_at_places(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    n, got = ranks.values_at(df, "v", lambda n: range(-1, n + 1, 1 + n // 20))
    assert n == len(known) and got == {p: known[p] for p in range(0, n) if p in got} and set(got) == {p for p in range(-1, n + 1, 1 + n // 20) if 0 <= p < n}
    breaks = tuple(measures.symmetric_breaks(df, "v").first())
    sizes = [v for v in known if v > 0]
    assert breaks == (tuple(sizes[min(len(sizes) - 1, math.floor(p * len(sizes)))] for p in (0.60, 0.85, 0.96)) if sizes else (1.0, 2.0, 3.0))
    for q in (0, 0.5, 1):
        kept = sorted(r[0] for r in measures.quantile_filter(df, "v", q).collect())
        assert kept == ([v for v in known if v >= known[math.floor(q * (len(known) - 1))]] if known else [])


def clusters(rng, kind):
    if kind == "far":
        return [(1e6 + rng.random(), -2e6 + rng.random()) for _ in range(40)]
    if kind == "clustered":
        return [(round(c + rng.random(), 1), round(c * 3 + rng.random(), 1)) for c in (0, 0, 0, 500) for _ in range(40)]
    return {"one": [(3.0, 4.0)], "line": [(float(i % 9), 2.0) for i in range(30)], "spread": [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(300)]}[kind]


@pytest.mark.parametrize("kind", ["far", "clustered", "one", "line", "spread"])
def test_nearest(spark, kind):
    rng = random.Random(6)
    targets = [(f"t{i:03}", x, y) for i, (x, y) in enumerate(clusters(rng, kind))] + [("none", None, 1.0)]
    points = [(f"p{i}", rng.choice([0.5, 2.0, rng.uniform(-600, 600)]), rng.uniform(-40, 1600)) for i in range(60)] + [("q", None, 1.0), *((f"s{i}", x, y) for i, (_, x, y) in enumerate(targets[:20]))]
    got = measures.nearest(spark.createDataFrame(points, "point string, x double, y double"), spark.createDataFrame(targets, "target string, tx double, ty double"))
    rows = {r["point"]: (r["target"], r["distance"]) for r in got.collect()}
    assert set(rows) == {p[0] for p in points if p[1] is not None}
    for name, x, y in points:
        if x is not None:
            far = {t: math.hypot(x - a, y - b) for t, a, b in targets if a is not None}
            assert math.isclose(rows[name][1], min(far.values()), rel_tol=1e-12) and math.isclose(far[rows[name][0]], min(far.values()), rel_tol=1e-12)
            assert rows[name][0] == min(t for t in far if far[t] == far[rows[name][0]])


def test_nearest_without_targets(spark):
    points = spark.createDataFrame([("p", 1.0, 2.0)], "point string, x double, y double")
    assert measures.nearest(points, spark.createDataFrame([("t", None, None)], "target string, tx double, ty double")).count() == 0


def ring(unit, number, corners):
    return [(unit, number, i, float(x), float(y)) for i, (x, y) in enumerate([*corners, corners[0]])]


SHAPES = {
    # an island in a hole, a second part, a slanted triangle that overlaps, and a thin one within a square
    "a": [[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (2, 7), (7, 7), (7, 2)], [(4, 4), (5, 4), (5, 5), (4, 5)], [(20.2, 1.1), (24.7, 1.3), (22.1, 6.9)]],
    "b": [[(-3.5, -2.5), (6.5, 4.5), (-1.5, 11.5)]],
    "c": [[(10.1, 10.1), (10.9, 10.2), (10.5, 10.8)]],
}


def holds(rings, x, y):
    inside = False
    for corners in rings:
        for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


@pytest.mark.parametrize("cell", [0.4, 1.0, 3.0, 50.0])
def test_points_in_polygons(spark, cell):
    rng = random.Random(9)
    vertices = spark.createDataFrame([v for u, rings in SHAPES.items() for k, r in enumerate(rings) for v in ring(u, k, r)], "unit string, ring int, i int, x double, y double")
    points = [(i, rng.uniform(-5, 26), rng.uniform(-4, 13)) for i in range(600)] + [(600 + i, float(rng.randrange(-4, 12)) + 0.25, float(rng.randrange(-3, 12))) for i in range(200)] + [(900, 10.5, 10.4)]
    points += [(900, 10.5, 10.4), (901, None, 4.5), (902, 4.5, None)]  # a repeated point has a row each, one without a place has none
    got = geo.points_in_polygons(spark.createDataFrame(points, "point int, x double, y double"), vertices, cell)
    assert sorted(map(tuple, got.collect())) == sorted((i, u) for i, x, y in points for u, rings in SHAPES.items() if None not in (x, y) and holds(rings, x, y))
    _, full, _ = geo.polygon_cells(vertices, cell)
    for u, i, j in full.collect():
        assert all(holds(SHAPES[u], (i + a) * cell, (j + b) * cell) for a in (0.01, 0.5, 0.99) for b in (0.01, 0.5, 0.99))
    assert full.count() > 0 or cell > 2


def test_area_of_a_polygon_with_a_hole_and_an_island(spark):
    vertices = spark.createDataFrame([v for k, r in enumerate(SHAPES["a"][:3]) for v in ring("a", k, r)], "unit string, ring int, i int, x double, y double")
    assert geo.polygon_area(vertices).first()["area"] == 81 - 25 + 1


def test_checks_in_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, None, "b"), (3, 5.0, None)], "k int, w double, g string")
    checks = [files.Check("rows", F.count(F.lit(1)), 2, 2), files.Check("weight", F.sum("w"), 100, None), files.Check("nulls", F.count(F.when(F.col("g").isNull(), 1)), None, 0)]
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = files.write_checked(df, f"file://{tmp_path}/t", checks, [files.Check("read", F.count(F.lit(1)), 3, None)], F.col("w").isNotNull())
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    assert {r["name"]: (r["value"], r["ok"]) for r in got.collect()} == {"read": (3.0, True), "rows": (2.0, True), "weight": (15.0, False), "nulls": (1.0, False)}
    assert jobs == 1 and spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    none = files.write_checked(df.limit(0), f"file://{tmp_path}/u", [files.Check("weight", F.sum("w"), 0, None)])
    assert tuple(none.select("value", "ok").first()) == (None, False)


def test_fixed_width_lines_are_counted_as_they_are_loaded(spark, tmp_path):
    (tmp_path / "f.txt").write_text("01 12345 a\n02       b\n03 x\n\n")
    layout = [("code", 1, 2, "string", 0), ("weight", 4, 5, "double", 2), ("kind", 10, 1, "string", 0)]
    got = files.load_fixed_width(spark, f"file://{tmp_path}/f.txt", layout, f"file://{tmp_path}/t", 10, most_bad=1, checks=[files.Check("weight", F.sum("weight"), 123, 124)])
    assert {r["name"]: (r["value"], r["ok"]) for r in got.collect()} == {"lines": (4.0, True), "rejected": (2.0, False), "weight": (123.45, True)}
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").collect())) == [("01", 123.45, "a"), ("02", None, "b")]

"""Panels against loops over editions: order statistics with ties, grouped regressions, dissimilarity, units of an edition."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from odflow.operators import audit, panels

FLOWS = "level string, edition string, o string, d string, total double, se double, km double"


def test_end_statistics(spark):
    rng = random.Random(8)
    rows = [("u", e, o, d, float(rng.choice([0, 5, 5, 10, 40])), 1.0, None if rng.random() < 0.1 else float(rng.choice([10, 20, 20, 35]))) for e in ("1", "2") for o in "abcdef" for d in "abcdef" if o != d and rng.random() < 0.7]
    rows.append(("v", "1", "x", "y", 3.0, 1.0, 7.0))
    got = {(r["level"], r["edition"], r["code"]): r for r in panels.end_statistics(spark.createDataFrame(rows, FLOWS)).collect()}

    def gini(x):
        return None if not x else sum(abs(a - b) for a in x for b in x) / (2 * len(x) * sum(x))

    same = lambda a, b: (a is None and b is None) or math.isclose(a, b, abs_tol=1e-12)
    known = [r for r in rows if r[4] > 0]
    assert {(r[0], r[1], c) for r in known for c in r[2:4]} == set(got)
    for (level, edition, code), r in got.items():
        own = [x for x in known if x[:2] == (level, edition) and code in x[2:4]]
        assert r["pairs"] == len(own)
        assert same(r["gini_out"], gini([x[4] for x in own if x[2] == code])) and same(r["gini_in"], gini([x[4] for x in own if x[3] == code]))
        far = sorted((x[6], x[4]) for x in own if x[6] is not None)
        whole, run, median = sum(w for _, w in far), 0.0, None
        for km, w in far:
            run += w
            if median is None and run >= 0.5 * whole:
                median = km
        assert same(r["median_km"], median) and same(r["mean_km"], sum(k * w for k, w in far) / whole if far else None)


def test_slopes_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.normal()), float(rng.uniform(1, 900)), float(rng.uniform(1, 50))) for k in "abc" for _ in range(9)]
    rows += [("two", 1.0, 10.0, 1.0), ("two", 2.0, 20.0, 1.0), *[("flat", float(i), 10.0, 1.0) for i in range(5)], *[("line", 2.0 + 3.0 * i, 10.0**i, 2.0) for i in range(1, 6)], ("line", 5.0, 0.0, 1.0), ("line", None, 5.0, 1.0)]
    got = {r["k"]: r for r in panels.slope_by(spark.createDataFrame(rows, "k string, y double, density double, pop double"), ["k"], "y", "density", "pop").collect()}
    for k in "abc":
        y, x, w = np.array([[r[1], math.log10(r[2]), r[3]] for r in rows if r[0] == k]).T
        design = np.stack([np.ones_like(x), x], axis=1)
        inverse = np.linalg.inv(design.T @ (design * w[:, None]))
        beta = inverse @ (design.T @ (w * y))
        error = math.sqrt((w * (y - design @ beta) ** 2).sum() / (len(y) - 2) * inverse[1, 1])
        assert math.isclose(got[k]["slope"], beta[1], rel_tol=1e-9) and math.isclose(got[k]["se"], error, rel_tol=1e-9)
    assert (got["two"]["slope"], got["flat"]["slope"], got["flat"]["se"]) == (None, None, None)
    assert got["line"]["n"] == 5 and math.isclose(got["line"]["slope"], 3.0) and got["line"]["se"] < 1e-9


def test_dissimilarity_of_editions(spark):
    f = [("u", "1", "a", "b", 1.0), ("u", "1", "b", "a", 3.0), ("u", "3", "a", "b", 3.0), ("u", "3", "b", "a", 9.0), ("u", "4", "c", "a", 2.0), ("u", "5", "c", "a", 0.0), ("w", "2", "a", "b", 1.0)]
    got = {(r["level"], r["edition"]): r["dissimilarity"] for r in panels.dissimilarity_series(spark.createDataFrame(f, "level string, edition string, o string, d string, total double")).collect()}
    assert got == {("u", "3"): 0.0, ("u", "4"): 1.0, ("u", "5"): None}


def test_units_of_an_edition(spark):
    people = spark.createDataFrame([("1", "n", "m", 1), ("2", "n", "m", 2), ("1", "m", None, 3)], "edition string, unit string, prev_unit string, id int")
    lineage = spark.createDataFrame([("n", "1", False, "p"), ("n", "2", True, None), ("m", "1", True, None)], "unit string, edition string, existed boolean, parent string")
    got = sorted(tuple(r) for r in panels.to_edition_units(people, lineage).select("id", "unit", "prev_unit").collect())
    assert got == [(1, "p", "m"), (2, "n", "m"), (3, "m", None)]


def test_panel_of_absent_units(spark):
    skeleton = spark.createDataFrame([("unit", "a", "1", 1), ("unit", "b", "1", 1), ("unit", "gone", "1", 0), ("unit", "still", "1", 1), ("metro", "m", "1", 2)], "level string, code string, edition string, present long")
    f = spark.createDataFrame([("unit", "1", "a", "b", 30.0, 3.0, 12.0), ("unit", "1", "b", "a", 10.0, 4.0, 12.0)], FLOWS)
    pop = spark.createDataFrame([("unit", "1", c, 100.0, 50.0) for c in ("a", "b", "still")], "level string, edition string, code string, pop double, pop5 double")
    borders = spark.createDataFrame([("unit", "a", "x"), ("unit", "b", "y")], "level string, code string, border string")
    errors = spark.createDataFrame([("1", "a", 2.0, 1.0)], "edition string, code string, se_in double, se_out double")
    outside = spark.createDataFrame([("metro", "1", "m", 7.0, 3.0)], "level string, edition string, code string, inflow double, outflow double")
    got = {r["code"]: r for r in panels.unit_panel(skeleton, f, pop, borders, errors, outside).collect()}
    a, still, gone, m = got["a"], got["still"], got["gone"], got["m"]
    assert (a["inflow"], a["outflow"], a["net_rate"], a["cross"], a["se_in"], a["pairs"], a["kind"]) == (10.0, 30.0, -400.0, 1.0, 2.0, 2, "strong_loss")
    assert (still["inflow"], still["pairs"], still["se_in"], still["effectiveness"], still["mean_km"]) == (0.0, 0, 0.0, None, None)
    assert (gone["inflow"], gone["pairs"], gone["kind"]) == (None, None, None)
    assert (m["inflow"], m["net"], m["se_in"], m["pairs"], m["kind"]) == (7.0, 4.0, None, None, "strong_gain")


def test_numbers_of_units_and_levels(spark):
    measures = spark.createDataFrame([("cmi", ["u"], ["moves"]), ("mei", ["u"], ["moves"]), ("net", ["u"], ["moves"])], "measure string, levels array<string>, requires array<string>")
    has = spark.createDataFrame([("1", ["moves"], []), ("2", ["moves"], []), ("3", ["moves"], []), ("0", [], [])], "edition string, has array<string>, partial array<string>")
    none = spark.createDataFrame([], "measure string, edition string, state string, note string")
    units = spark.createDataFrame([("u", "0", 9), ("u", "1", 19), ("u", "2", 30), ("u", "3", 30)], "level string, edition string, units long")
    got = {(r["measure"], r["edition"]): (r["state"], r["note"]) for r in panels.comparability(measures, has, none, units=units, changing=["cmi"], stable={"mei": 20}).collect()}
    moved, fine = ("with_caveat", "number_of_units"), ("comparable", None)
    assert [got["cmi", e] for e in "123"] == [moved, fine, fine] and [got["mei", e] for e in "123"] == [moved, fine, fine] and [got["net", e] for e in "123"] == [fine, fine, fine]
    assert {got[m, "0"] for m in ("cmi", "mei", "net")} == {("not_comparable", "moves")}


def test_reconcile_counts_repeats_and_nulls(spark):
    a = spark.createDataFrame([("x", None, 1.0), ("x", None, 1.0), ("y", 2, 3.0)], "k string, n int, weight double")
    b = spark.createDataFrame([("x", None, 1.0), ("y", 3, 4.0)], "k string, n int, weight double")
    got = {r["check"]: (r["left"], r["right"], r["ok"]) for r in audit.reconcile(a, b, {"k": ["k"], "both": ["k", "n"]}).collect()}
    assert got == {"rows": (3.0, 2.0, False), "weight": (5.0, 5.0, True), "k": (1.0, 0.0, False), "both": (2.0, 1.0, False)}
    assert {r["ok"] for r in audit.reconcile(a.filter("k = ''"), a.filter(F.lit(False)), {"k": ["k"]}).collect()} == {True}

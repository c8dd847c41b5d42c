"""Rules of the survey on literal rows: what each function returns over zero, nothing and ties, and classes by their names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.functions import recode as R
from odflow.operators import audit, flows, geo, measures, metro, release

FLOW = "o string, d string, total double"
UNITS = "unit string, level2 string"


def zero_flows(spark):
    return spark.createDataFrame([("A", "B", 0.0), ("B", "A", 0.0)], FLOW)


@pytest.mark.parametrize("name", ["partner_gini", "pct_cross", "dissimilarity", "system_measures", "weighted_slope", "multiplicative_components", "smi", "weighted_centroid", "suppression_report"])
def test_null_over_zero(spark, name):
    zero = zero_flows(spark)
    units = spark.createDataFrame([("A", "x"), ("B", "y")], UNITS)
    line = spark.createDataFrame([(1.0, float(i), 1.0) for i in range(4)], "x double, y double, w double")
    points = spark.createDataFrame([("k", 1.0, 2.0, 0.0)], "k string, lon double, lat double, w double")
    rates = spark.createDataFrame([("2000", "a", 0.5)], "edition string, band string, rate double")
    shown = {
        "partner_gini": lambda: flows.partner_gini(zero, "o").select("gini"),
        "pct_cross": lambda: flows.pct_cross(zero, units, "level2").select("share"),
        "dissimilarity": lambda: flows.dissimilarity(zero, zero),
        "system_measures": lambda: flows.system_measures(zero, 0.0).select("cmi", "mei", "anmr"),
        "weighted_slope": lambda: flows.weighted_slope(line, "x", "y", "w").select("slope", "intercept"),
        "multiplicative_components": lambda: flows.multiplicative_components(zero).select("o_share", "d_share", "od_ratio"),
        "smi": lambda: measures.smi(rates, spark.createDataFrame([("a", 0.0)], "band string, pop double")).select("smi"),
        "weighted_centroid": lambda: geo.weighted_centroid(points, ["k"], "w").select("lon", "lat"),
        "suppression_report": lambda: release.suppression_report(zero, zero).select("pct_volume"),
    }
    rows = shown[name]().collect()
    assert rows and all(v is None for r in rows for v in r)


def test_shares_of_empty_tables(spark):
    none = spark.createDataFrame([], FLOW)
    assert tuple(audit.check_share(none, F.col("total") > 0, 1, 2).select("value", "ok").first()) == (None, False)
    points = spark.createDataFrame([], "point string, unit string")
    assert tuple(audit.check_geometry(points, points).select("value", "ok").first()) == (None, False)
    assert flows.dissimilarity(none, none).first()[0] is None and flows.system_measures(none, 5.0).first()["mei"] is None
    assert release.suppression_report(none, none).first()["pct_volume"] is None


STATUS = [
    # prev_local, prev_unit, birth_local, birth_unit, nationality
    (("3", None, "2", "01", "1"), "abroad_citizen"), (("3", None, "3", None, "2"), "abroad_citizen"), (("3", None, "3", None, "3"), "abroad_foreigner"), (("3", None, None, None, None), "abroad_foreigner"),
    (("2", "05", "1", "01", "1"), "return"), (("2", "99", "1", "01", "1"), "return"), (("2", "05", "3", None, "3"), "born_abroad"), (("2", "99", "3", None, "1"), "born_abroad"),
    (("2", "99", "2", "07", "1"), "unknown_origin"), (("2", "99", None, None, None), "unknown_origin"), (("2", "07", "2", "07", "1"), "first_exit"), (("2", "05", "2", "07", "1"), "multi_stage"),
    (("2", "05", "2", None, "1"), "other"), (("2", None, None, None, None), "other"), ((None, None, "3", None, "3"), None), (("1", "05", "2", "05", "1"), None),
]


def test_status_of_each_row(spark):
    df = spark.createDataFrame([r for r, _ in STATUS], "prev_local string, prev_unit string, birth_local string, birth_unit string, nationality string")
    assert [r[0] for r in df.select(R.classify_status()).collect()] == [want for _, want in STATUS]


def test_unit_indicators_of_both_ends(spark):
    people = [  # unit, prev_local, prev_unit, stratum, psu, weight, age
        ("A", "2", "B", "s", 1, 10.0, 30), ("A", "2", "B", "s", 1, 10.0, 3), ("A", None, None, "s", 2, 5.0, 40), ("A", "2", "99", "s", 2, 7.0, 40), ("A", "3", None, "s", 3, 2.0, 9),
        ("A", "2", "A", "s", 3, 1.0, 9), ("B", "2", "A", "t", 4, 4.0, 20), ("B", None, None, "t", 5, 6.0, 1),
    ]
    persons = flows.flag_flow(spark.createDataFrame(people, "unit string, prev_local string, prev_unit string, stratum string, psu long, weight double, age int"))
    frame = spark.createDataFrame([("s", 3), ("t", 2)], "stratum string, n_h long")
    dim = spark.createDataFrame([("A",), ("B",), ("C",)], "unit string")
    got = {r["unit"]: r.asDict() for r in flows.unit_indicators(persons, dim, frame).collect()}
    a = got["A"]
    assert (a["pop"], a["pop5"], a["inflow"], a["outflow"], a["unknown_origin"], a["international"]) == (35.0, 25.0, 20.0, 4.0, 8.0, 2.0)
    assert (a["n_in"], a["n_out"], a["n_unknown"], a["n_international"], a["psu_in"], a["psu_out"]) == (2, 1, 2, 1, 1, 1)
    # one household of 20 among three: 3/2 (400 - 400/3); one of 4 among two: 2 (16 - 16/2)
    assert math.isclose(a["se_in"] ** 2, 1.5 * (400 - 400 / 3)) and math.isclose(a["se_out"] ** 2, 16.0) and math.isclose(a["se_net"] ** 2, 400 + 16.0)
    assert math.isclose(a["cv_in"], 100 * a["se_in"] / 20) and math.isclose(a["in_rate"], 800.0) and math.isclose(a["out_rate"], 160.0)
    assert (got["C"]["pop"], got["C"]["n_in"], got["C"]["se_net"], got["C"]["cv_in"], got["C"]["in_rate"]) == (0.0, 0, 0.0, None, None)
    released = {r["unit"]: r.asDict() for r in release.publish_units(flows.unit_indicators(persons, dim, frame)).collect()}
    assert (released["A"]["precision_in"], released["A"]["in_band"], released["C"]["precision_out"], released["A"]["pop"]) == ("low", "<5", "none", 35.0)


def test_null_categories_are_folded_or_dropped(spark):
    cells = spark.createDataFrame([("A", "x", "p", 10.0, 9, 9), ("A", "x", None, 4.0, 9, 9), ("A", "x", "q", 1.0, 1, 1)], "unit string, dimension string, category string, total double, n long, n_psu long")
    take = lambda nulls: sorted((r["category"], r["total"]) for r in release.suppress_long(cells, ["unit"], nulls=nulls).collect())
    assert take("fold") == [("other", 5.0), ("p", 10.0)] and take("drop") == [("other", 1.0), ("p", 10.0)]
    with pytest.raises(ValueError):
        release.suppress_long(cells, ["unit"], nulls="x")


def test_names_are_compared_without_accents(spark):
    rows = [("m", "Região de Brașov", "1", "BRAŞOV", 10), ("m", "Região de Brașov", "2", "Outra", 99), ("n", "Grande Łódź", "3", "Ḁḃċ", 5)]
    got = metro.infer_core(spark.createDataFrame(rows, "metro string, metro_name string, unit string, unit_name string, pop long"))
    assert {r["metro"]: (r["core"], r["named"]) for r in got.collect()} == {"m": ("1", True), "n": ("3", False)}


def fitted(spark, seed, rows, cols, **more):
    cells, status = flows.fit_margins(spark.createDataFrame(seed, FLOW), spark.createDataFrame(rows, "o string, target double"), spark.createDataFrame(cols, "d string, target double"), **more)
    return {(r["o"], r["d"]): r["total"] for r in cells.collect()}, status.first().asDict()


def test_fit_with_zero_margins(spark):
    rng = np.random.default_rng(3)
    seed = rng.uniform(1, 9, (4, 5))
    seed[0, 1] = 0
    rows, cols = np.array([10.0, 0.0, 20.0, 30.0]), np.array([15.0, 15.0, 0.0, 10.0, 20.0])
    x = seed.copy()
    for _ in range(500):
        for axis, target in ((1, rows), (0, cols)):
            s = x.sum(axis=axis)
            f = np.divide(target, s, out=np.zeros_like(target), where=s > 0)
            x = x * (f[:, None] if axis == 1 else f[None, :])
    cells, status = fitted(spark, [(f"r{i}", f"c{j}", float(seed[i, j])) for i in range(4) for j in range(5)], [(f"r{i}", float(v)) for i, v in enumerate(rows)], [(f"c{j}", float(v)) for j, v in enumerate(cols)])
    assert len(cells) == 19 and all(abs(v - x[int(o[1:]), int(d[1:])]) < 1e-6 for (o, d), v in cells.items())
    assert status["converged"] and status["error"] <= 1e-9 and (status["unreached"], status["blocks"], status["unbalanced"]) == (0, 1, 0) and status["rounds"] % 5 == 0


def test_fit_tells_what_cannot_be_reached(spark):
    # two blocks with margins of their own; the second one's do not agree
    seed = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 1.0)]
    cells, status = fitted(spark, seed, [("a", 6.0), ("b", 4.0)], [("x", 3.0), ("y", 3.0), ("z", 5.0)], rounds=10)
    assert not status["converged"] and (status["blocks"], status["unbalanced"], status["unreached"]) == (2, 1, 0)
    assert math.isclose(cells["a", "x"], 3.0) and math.isclose(cells["a", "y"], 3.0)
    # c has a target and no cell but one whose other end is 0
    _, status = fitted(spark, [("a", "x", 1.0), ("c", "y", 1.0)], [("a", 6.0), ("c", 2.0)], [("x", 6.0), ("y", 0.0)], rounds=5)
    assert not status["converged"] and status["unreached"] == 1
    cells, status = fitted(spark, [], [("a", 6.0)], [("x", 6.0)], rounds=5)
    assert cells == {} and not status["converged"] and status["unreached"] == 2


def test_blocks_of_a_long_chain(spark):
    chain = [(f"o{i:03}", f"d{i + j:03}", 1.0) for i in range(40) for j in (0, 1)] + [("z", "zz", 1.0)]
    got = {(r["side"], r["key"]): r["block"] for r in flows.seed_blocks(spark.createDataFrame(chain, FLOW)).collect()}
    assert {v for (s, k), v in got.items() if not k.startswith("z")} == {"o000"} and got["d", "zz"] == "z" and len(got) == 40 + 41 + 2

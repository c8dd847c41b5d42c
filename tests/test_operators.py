"""Operators on small literal tables, files written by the tests, and defects planted one at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.functions import recode as R
from odflow.operators import audit, estimate, flows, measures, panels, release, series
from odflow.plans.queries import QUERIES
from odflow.sources import files
from odflow.spec import EditionSpec, Limits


def test_delimited_files_unite_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name\n01,x\n02,\n")
    (tmp_path / "b.csv").write_text("name,extra,code\ny,7,03\n")
    got = files.read_delimited(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"])
    assert sorted((r["code"], r["name"], r["extra"]) for r in got.collect()) == [("01", "x", None), ("02", None, None), ("03", "y", "7")]


def test_fixed_width_and_short_records(spark, tmp_path):
    (tmp_path / "f.txt").write_text("01 12345 a\n02       b\n03 x\n")
    layout = [("code", 1, 2, "string", 0), ("weight", 4, 5, "double", 2), ("kind", 10, 1, "string", 0)]
    got = files.read_fixed_width(spark, f"file://{tmp_path}/f.txt", layout, min_length=10)
    assert sorted(map(tuple, got.collect())) == [("01", 123.45, "a"), ("02", None, "b")]
    good, counts = files.reject_short(spark.read.text(f"file://{tmp_path}/f.txt"), 10)
    assert good.count() == 2 and tuple(counts.first()) == (2, 1)


def test_patch_contract_and_sinks(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    patch = spark.createDataFrame([(1, "z")], "k long, v string")
    assert sorted(map(tuple, files.patch_rows(base, patch, "k").collect())) == [(1, "z"), (2, "c")]
    got = files.project_contract(base, [("key", "k", "string"), ("asked", None, "boolean")])
    assert got.dtypes == [("key", "string"), ("asked", "boolean")] and got.first()["asked"] is None
    files.write_table(base, f"file://{tmp_path}", "t")
    files.write_table(patch, f"file://{tmp_path}", "u")
    assert files.read_parts(spark, [f"file://{tmp_path}/t", f"file://{tmp_path}/u"], 2).count() == 4
    with pytest.raises(ValueError):
        files.read_parts(spark, [f"file://{tmp_path}/t"], 2)


def test_row_arrays_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 1.236, None), ("a", 1, 0.5, 'q"')], "c string, n long, x double, t string")
    files.write_row_arrays(df, f"file://{tmp_path}/j", ["c"], digits=2)
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == [["a", 1, 0.5, 'q"'], ["b", 2, 1.24, None]]
    files.write_csv(df, f"file://{tmp_path}/c", "made by a test", F.col("n") > 1)
    back = spark.read.csv(f"file://{tmp_path}/c", header=True).collect()
    assert [(r["c"], r["source"]) for r in back] == [("b", "made by a test")]


def test_manifest_tells_missing_extra_and_changed(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    made = audit.table_manifest({"same": a, "changed": a, "gone": a})
    now = audit.table_manifest({"same": a.orderBy(F.desc("k")), "changed": a.withColumn("v", F.coalesce("v", F.lit("y"))), "new": a})
    assert {r["name"]: r["state"] for r in audit.verify_manifest(made, now).collect()} == {"same": "same", "changed": "changed", "gone": "missing", "new": "extra"}


def test_multiset_difference_counts_repeats_and_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert tuple(audit.multiset_diff(a, b, ["k"]).first()) == (1, 1)


def test_fit_meets_both_margins(spark):
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 6, (5, 5)).astype(float)
    np.fill_diagonal(seed, 2)
    target = rng.integers(1, 9, (5, 5)).astype(float)
    cells = [(f"o{i}", f"d{j}", float(seed[i, j])) for i in range(5) for j in range(5)] + [("o9", "d0", 3.0)]
    rows = spark.createDataFrame([(f"o{i}", float(x)) for i, x in enumerate(target.sum(1))], "o string, target double")
    cols = spark.createDataFrame([(f"d{j}", float(x)) for j, x in enumerate(target.sum(0))], "d string, target double")
    got = {(r["o"], r["d"]): r["total"] for r in flows.ipf(spark.createDataFrame(cells, "o string, d string, total double"), rows, cols, rounds=200).collect()}
    x = seed.copy()
    for _ in range(400):
        x *= (target.sum(1) / x.sum(1))[:, None]
        x *= target.sum(0) / x.sum(0)
    assert all(abs(got.get((f"o{i}", f"d{j}"), 0.0) - x[i, j]) < 1e-6 for i in range(5) for j in range(5)) and ("o9", "d0") not in got


def test_fitted_flows_meet_the_transposed_margins(spark):
    dense = "/root/testdata/sf0.01"
    f = {(r["o"], r["d"]): r["total"] for r in QUERIES["flow_matrix"](spark, dense).collect()}
    got = {(r["o"], r["d"]): r["total"] for r in QUERIES["fitted_flows"](spark, dense).collect()}
    assert set(got) == set(f)
    for unit in {o for o, _ in f}:
        want = sum(v for (_, d), v in f.items() if d == unit)
        assert abs(sum(v for (o, _), v in got.items() if o == unit) - want) < 1e-6 * max(1.0, want)


def test_complementary_uses_both_floors(spark):
    cells = spark.createDataFrame([("g", "a", 50.0, 9, 2), ("g", "b", 20.0, 9, 5), ("g", "c", 30.0, 9, 5)], "k string, category string, total double, n long, n_psu long")
    kept = release.complementary(cells, ["k"])
    assert {r["category"]: r["kept"] for r in kept.collect()} == {"a": False, "b": False, "c": True}
    assert release.audit_differencing(kept, ["k"]).count() == 0
    assert release.audit_differencing(cells.withColumn("kept", F.col("category") != "a"), ["k"]).count() == 1
    assert release.suppress_rows(cells, Limits.of(False)).count() == 0


def test_detail_is_masked_below_its_floor(spark):
    df = spark.createDataFrame([(19, 1.0), (20, 2.0)], "n long, x double")
    assert [r["x"] for r in release.mask_detail(df, ["x"], 20).orderBy("n").collect()] == [None, 2.0]


def test_a_release_with_one_defect_fails_its_audit(spark):
    good = spark.createDataFrame([(10.0, "5-19")], "total double, n_band string")
    bad = {"off_base": good.withColumn("total", F.lit(11.0)), "bad_bands": good.withColumn("n_band", F.lit("<5")), "banned_columns": good.withColumn("psu", F.lit(1))}
    assert not any(audit.audit_structure(good).first())
    for name, table in bad.items():
        assert audit.audit_structure(table).first()[name] == 1
    assert R.bands_below(5) == ["<5"] and R.bands_below(20) == ["<5", "5-19"]


def test_declared_households(spark):
    persons = spark.createDataFrame([(None,), (None,)], "psu long")
    assert tuple(audit.audit_psu_declared(persons, True).first()) == (0, False)
    assert audit.audit_psu_declared(persons, False).first()["ok"]


@pytest.mark.parametrize("share,direct,state", [(None, None, "none"), (0.0, 0.0, "none"), (0.5, 0.5, "insufficient"), (0.95, 0.95, "partial"), (1.0, 0.9, "partial"), (1.0, 1.0, "full"), (1.0, None, "full")])
def test_coverage_state(spark, share, direct, state):
    df = spark.createDataFrame([(share, direct)], "share double, direct double")
    assert df.select(series.coverage_state("share", "direct")).first()[0] == state


def test_coverage_inside_a_region_is_stricter(spark):
    df = spark.createDataFrame([(1.0, 0.8, 5, False), (1.0, 1.0, 1, False), (1.0, 1.0, 5, True), (1.0, 1.0, 5, False)], "share double, direct double, present long, other boolean")
    got = [r[0] for r in df.select(series.coverage_state("share", "direct", intra=True, members="present", other_core="other")).collect()]
    assert got == ["insufficient", "insufficient", "insufficient", "full"]


def test_check_digit(spark):
    df = spark.createDataFrame([("1700251",), ("1700250",), ("170025",), (None,)], "code string")
    assert tuple(audit.code_check_digit(df, "code").first()) == (3, 2)


def test_guard_raises(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    with pytest.raises(Exception, match="no code"):
        df.select(R.require("c", F.col("c").isNotNull(), "no code")).collect()


def test_edition_limits():
    assert EditionSpec("1980", 1.0, has_psu=False).limits == Limits(20, None, 50)


def test_loglinear_needs_two_by_two(spark):
    f = spark.createDataFrame([("u", "2000", "A", "X", 100.0), ("u", "2000", "A", "Y", 50.0), ("u", "2000", "B", "X", 60.0), ("u", "2000", "B", "Y", 90.0), ("u", "1999", "A", "X", 5.0)], "level string, edition string, o string, d string, total double")
    for coding in ("total", "geometric"):
        rows = panels.loglinear_series(f, coding).collect()
        assert len(rows) == 4 and all(abs(r["t"] * r["o_effect"] * r["d_effect"] * r["od_effect"] - r["total"]) < 1e-9 for r in rows)


def test_empty_flows(spark):
    f = spark.createDataFrame([], "o string, d string, total double")
    assert flows.level_indicators(f).count() == 0 and flows.system_measures(f, 10.0).first()["moves"] is None


def test_first_row_of_each_group_and_outer_pairs(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 5.0), ("x", 3, 4.0), ("y", 9, None), ("y", 8, 1.0)], "k string, id int, v double")
    got = measures.arg_top(df, ["k"], [F.col("v").desc_nulls_last(), F.col("id")])
    assert sorted(map(tuple, got.collect())) == [("x", 1, 5.0), ("y", 8, 1.0)]
    a = spark.createDataFrame([("p", "q", 2.0), ("q", "p", 1.0)], "o string, d string, total double")
    b = spark.createDataFrame([("p", "q", 3.0), ("r", "p", 7.0)], "o string, d string, total double")
    assert sorted(map(tuple, flows.outer_pairs(a, b).collect())) == [("p", "q", 2.0, 3.0), ("q", "p", 1.0, 0.0), ("r", "p", 0.0, 7.0)]


def test_share_check_digit_and_classes(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("a", 4.0, None), ("z", 0.0, True)], "k string, weight double, yes boolean")
    got = df.groupBy("k").agg(estimate.weighted_share(F.col("yes")).alias("share"))
    assert {r.k: r.share for r in got.collect()} == {"a": 12.5, "z": None}
    codes = spark.createDataFrame([("110001",), ("355030",), ("000000",)], "c string")
    assert [r[0] for r in codes.select(R.check_digit("c")).collect()] == ["5", "8", "0"]
    cv = spark.createDataFrame([(None,), (15.0,), (15.1,), (30.0,), (30.1,)], "cv double")
    assert [r[0] for r in cv.select(R.precision_class("cv")).collect()] == ["none", "good", "caution", "caution", "low"]
    rows = [(True, "A", "A", "C", None), (True, "C", "A", "C", None), (True, "B", "A", "C", None), (False, None, "A", "C", "2"), (None, None, "A", "C", "5"), (False, None, "A", "C", "4"), (False, None, "A", "C", None)]
    work = spark.createDataFrame(rows, "go boolean, work string, before string, core string, local string")
    got = [r[0] for r in work.select(R.work_class("go", "work", "before", "core", "local")).collect()]
    assert got == ["origin", "core", "other", "own", "several", "abroad", "unknown"]

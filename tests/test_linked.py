"""Linked suppression against linear algebra: what the published cells and margins leave free."""

import random

import numpy as np
import pytest

from odflow.operators import linked

CELLS = "t string, o string, d string, total double, n long, n_psu long"


def derivable(rows, margins):
    """Hidden cells that the published equations fix: those in which no vector of the null space moves."""
    out = set()
    for t in {r["t"] for r in rows}:
        gone = [(r["o"], r["d"]) for r in rows if r["t"] == t and r["hidden"]]
        told = [(m["side"], m["unit"]) for m in margins if m["t"] == t and m["published"]]
        if not gone:
            continue
        a = np.array([[1.0 if cell["od".index(side)] == unit else 0.0 for cell in gone] for side, unit in told] or [[0.0] * len(gone)])
        _, s, v = np.linalg.svd(a)
        free = v[(s > 1e-9).sum() :]
        out |= {(t, *c) for k, c in enumerate(gone) if not len(free) or np.abs(free[:, k]).max() < 1e-9}
    return out


def tables(seed, size, small):
    rng = random.Random(seed)
    return [(t, o, d, float(rng.randrange(5, 900)), 2 if rng.random() < small else 50, 9) for t in ("x", "y") for o in "abcdefghij"[:size] for d in "abcdefghij"[:size] if o != d and rng.random() < 0.6]


@pytest.mark.parametrize("seed,size,small", [(1, 6, 0.1), (2, 5, 0.3), (3, 3, 0.3)])
def test_nothing_hidden_can_be_worked_out(spark, seed, size, small):
    rows = tables(seed, size, small)
    cells, margins = (x.collect() for x in linked.protect_margins(spark.createDataFrame(rows, CELLS), ["t"]))
    assert len(cells) == len(rows) and {(r["t"], r["o"], r["d"]) for r in cells if r["hidden"] == "floor"} == {r[:3] for r in rows if r[4] < 5}
    assert derivable(cells, margins) == set()
    before = [dict(zip(("t", "o", "d"), r[:3]), hidden="floor" if r[4] < 5 else None) for r in rows]
    assert derivable(before, [m.asDict() | {"published": True} for m in margins])


def test_a_cell_alone_withholds_its_margins(spark):
    cells, margins = linked.protect_margins(spark.createDataFrame([("x", "a", "b", 9.0, 1, 1), ("x", "c", "d", 9.0, 50, 9)], CELLS), ["t"])
    assert {(r["o"], r["hidden"]) for r in cells.collect()} == {("a", "floor"), ("c", None)}
    assert {(m["side"], m["unit"], m["published"]) for m in margins.collect()} == {("o", "a", False), ("d", "b", False), ("o", "c", True), ("d", "d", True)}


def test_bridge_between_two_cycles(spark):
    square = lambda o, d: [(o[i], d[j]) for i in (0, 1) for j in (0, 1)]
    edges = [*square("ab", "xy"), *square("ef", "uv"), ("a", "u"), ("p", "q"), ("p", "r"), ("b", "x")]
    df = spark.createDataFrame([(str(i), o, d) for i, (o, d) in enumerate(edges)], "id string, o string, d string")
    assert sorted(r["id"] for r in linked.bridges(df).collect()) == ["10", "8", "9"]
    assert linked.bridges(df.limit(0)).count() == 0


def test_nothing_to_hide(spark):
    df = spark.createDataFrame([("x", "a", "b", 9.0, 50, 9)], CELLS)
    for some in (df, df.limit(0)):
        cells, margins = linked.protect_margins(some, ["t"])
        assert cells.filter("hidden is not null").count() == 0 and margins.filter("not published").count() == 0

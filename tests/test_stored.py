"""What is stored for several queries, and how many persons the queries on top of it move."""

import pytest

from odflow.plans.panel_queries import people
from odflow.plans.queries import QUERIES, Survey
from odflow.plans.views import PERSONS, read

PERSONS_TEXT = PERSONS
for _t in ("lineitem", "orders", "customer", "supplier", "part"):
    PERSONS_TEXT = PERSONS_TEXT.replace(f"FROM {_t} ", f"FROM {{{_t}}} ").replace(f"JOIN {_t} ", f"JOIN {{{_t}}} ")


@pytest.fixture()
def folder(spark, tmp_path):
    """The tables under a path of their own, while no table of many rows is small enough to be broadcast."""
    (tmp_path / "t").symlink_to("/root/testdata/sf0.01")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    yield str(tmp_path / "t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("odflow_")}


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_persons_of_editions_are_neither_stored_nor_shuffled(spark, folder):
    old, s = stored(spark), Survey(spark, folder)
    rows = people(s)
    assert {t.rsplit("_", 1)[0] for t in stored(spark) - old} == {"odflow_persons", "odflow_lineage"}
    assert "Exchange hashpartitioning" not in plan_of(rows.groupBy("edition", "unit", "prev_unit", "work_unit", "study_unit", "stratum", "psu").count())
    assert rows.count() == s.persons.count() and rows.filter("edition < '1998' and unit >= '20'").count() == 0


def test_making_persons_ends_with_the_exchange_by_household(spark, folder):
    old, s, parts = shuffled(spark), Survey(spark, folder), spark.conf.get("spark.sql.shuffle.partitions")
    # columns are made after the last exchange, which serves the buckets
    plan = plan_of(s._view.repartition(int(parts), "psu"))
    assert "hashpartitioning(psu" not in plan and "hashpartitioning(l_orderkey" in plan
    s.persons
    assert shuffled(spark) <= old and spark.conf.get("spark.sql.shuffle.partitions") == parts
    want = {tuple(r) for r in spark.sql(PERSONS_TEXT, **{t: read(spark, folder, t) for t in ("lineitem", "orders", "customer", "supplier", "part")}).collect()}
    assert {tuple(r) for r in s.persons.drop("is_flow").collect()} == want


def test_comparability_takes_the_number_of_units_alone(spark, folder):
    old = stored(spark)
    got = QUERIES["system_comparability"](spark, folder)
    assert {t.rsplit("_", 1)[0] for t in stored(spark) - old} == {"odflow_persons", "odflow_lineage"}
    assert got.count() == 91


def test_only_the_units_asked_for_are_joined(spark, folder):
    s = Survey(spark, folder)
    whole = people(s)
    for columns in ((), ("unit",), ("unit", "prev_unit")):
        some = people(s, columns)
        assert plan_of(some).count("BroadcastHashJoin") == len(columns)
        same = ["psu", "stratum", *columns, *(["is_flow"] if len(columns) == 2 else [])]
        assert some.select(same).exceptAll(whole.select(same)).count() == 0 and ("is_flow" in some.columns) == (len(columns) == 2)

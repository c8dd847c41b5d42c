"""Queries that write a table as survey files, in the shared folder, and read it again: what readers give is what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators import audit, measures
from odflow.plans.queries import Survey, query
from odflow.plans.views import read
from odflow.sources import files, store


def _folder(s: Survey) -> str:
    return f"{store.shared_folder(s.spark)}/{uuid.uuid4().hex}"


def _customers(s: Survey) -> DataFrame:
    return read(s.spark, s.sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))


@query("SELECT c_custkey AS code, c_nationkey AS unit, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS kind, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CAST(NULL AS BOOLEAN) AS asked FROM customer")
def delimited_files(s: Survey) -> DataFrame:
    """Two files of other columns in another order, united by name, under one contract."""
    c, at = _customers(s), _folder(s)
    known = F.when(F.col("balance") > 0, F.col("balance").cast("string")).otherwise(" ")
    c.filter("code % 2 = 0").select("code", "unit", "kind", known.alias("balance")).write.csv(f"{at}/a", header=True)
    c.filter("code % 2 = 1").select(known.alias("balance"), "unit", F.lit("x").alias("extra"), "code").write.csv(f"{at}/b", header=True)
    rows = files.read_delimited(s.spark, [f"{at}/a", f"{at}/b"])
    rows = rows.withColumn("balance", F.expr("try_cast(nullif(trim(balance), '') as double)"))
    return files.project_contract(rows, [("code", "code", "long"), ("unit", "unit", "int"), ("kind", "kind", "string"), ("balance", "balance", "double"), ("asked", None, "boolean")])


def _lines(s: Survey) -> DataFrame:
    """Orders as lines of fixed width, the price in cents; those of every thirteenth order are cut short."""
    o = read(s.spark, s.sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") % 5 == 0, F.lpad(F.lit(""), 12, " ")).otherwise(F.lpad(cents, 12, " ")), F.lit(" "), F.col("o_orderstatus"))
    return o.select(F.when(F.col("o_orderkey") % 13 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))


_LAYOUT = [("code", 1, 10, "string", 0), ("price", 11, 12, "double", 2), ("status", 24, 1, "string", 0)]


@query("SELECT lpad(CAST(o_orderkey AS STRING), 10, '0') AS code, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 13 <> 0")
def fixed_width_file(s: Survey) -> DataFrame:
    """Lines of fixed width with implied decimals and blanks; short ones are left out."""
    at = _folder(s)
    _lines(s).write.text(at)
    return files.read_fixed_width(s.spark, at, _LAYOUT, min_length=24)


@query("SELECT 'lines' AS name, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, true AS ok FROM orders UNION ALL SELECT 'rejected', count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END), NULL, 0, count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) <= 0 FROM orders UNION ALL SELECT 'unpriced', count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END), 1, NULL, count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) >= 1 FROM orders WHERE o_orderkey % 13 <> 0")
def fixed_width_load(s: Survey) -> DataFrame:
    """What was read, rejected and loaded, counted in the pass that writes the table."""
    at = _folder(s)
    _lines(s).write.text(f"{at}/lines")
    return files.load_fixed_width(s.spark, f"{at}/lines", _LAYOUT, f"{at}/table", 24, most_bad=0, checks=[files.Check("unpriced", F.count(F.when(F.col("price").isNull(), 1)), 1)])


@query("SELECT o_orderkey AS code, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS issue FROM orders WHERE o_orderkey % 14 <> 0 OR o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'again', 1 FROM orders WHERE o_orderkey % 14 = 0 AND o_orderstatus = 'O'")
def reissued_rows(s: Survey) -> DataFrame:
    """A table of three parts, of which the keys of a patch come from the patch alone."""
    o, at = read(s.spark, s.sf_dir, "orders").select(F.col("o_orderkey").alias("code"), F.col("o_orderstatus").alias("status")), _folder(s)
    paths = [f"{at}/{k}" for k in range(3)]
    for k, path in enumerate(paths):
        o.filter(F.col("code") % 3 == k).withColumn("issue", F.lit(0)).write.parquet(path)
    again = o.filter("code % 7 = 0 and (code % 14 <> 0 or status = 'F')").unionByName(o.filter("code % 14 = 0 and status = 'O'").withColumn("status", F.lit("again")))
    # the patch has all keys that are multiples of 7; of those of 14 only two kinds of rows come back
    gone = o.filter("code % 14 = 0").select("code", "status", F.lit(1).alias("issue"))
    base = files.patch_rows(files.read_parts(s.spark, paths, 3), gone, "code").filter("issue = 0")
    return files.patch_rows(base, again.withColumn("issue", F.lit(1)), "code")


@query("SELECT '[' || to_json(lpad(CAST(n_nationkey AS STRING), 2, '0')) || ',' || to_json(n_name) || ',' || CAST(n_regionkey AS STRING) || ',' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE to_json(CAST(n_nationkey AS DOUBLE)) END || ']' AS value FROM nation")
def rows_as_arrays(s: Survey) -> DataFrame:
    """One JSON array a row."""
    at = _folder(s)
    k = F.col("n_nationkey")
    rows = read(s.spark, s.sf_dir, "nation").select(F.lpad(k.cast("string"), 2, "0").alias("code"), "n_name", "n_regionkey", F.when(k % 2 == 1, k.cast("double")).alias("x"))
    files.write_row_arrays(rows, at, ["code"], digits=2)
    return s.spark.read.text(at)


@query("SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS unit, n_name AS name, 'survey of units' AS source FROM nation WHERE n_regionkey < 3")
def exported_csv(s: Survey) -> DataFrame:
    """A CSV export of some rows with its attribution."""
    at = _folder(s)
    files.write_csv(s.units.select("unit", F.col("unit_name").alias("name"), F.col("level2")), at, "survey of units", F.col("level2") < "3")
    return s.spark.read.csv(at, header=True).select("unit", "name", "source")


@query("SELECT name, state FROM (SELECT 'flows' AS name, CASE WHEN (SELECT count(*) FROM flow WHERE o = '03') > 0 THEN 'changed' ELSE 'same' END AS state UNION ALL SELECT 'units', 'same' UNION ALL SELECT 'cores', 'missing' UNION ALL SELECT 'frame', 'extra')")
def manifest_of_a_changed_release(s: Survey) -> DataFrame:
    """Tables that are missing, extra, changed and the same against a manifest."""
    flow = s.flow()
    made = audit.table_manifest({"flows": flow, "units": s.units, "cores": s.cores})
    return audit.verify_manifest(made, audit.table_manifest({"flows": flow.filter("o <> '03'"), "units": s.units.orderBy("level2"), "frame": s.frame}))


@query("SELECT o, d, total FROM flow QUALIFY row_number() OVER (PARTITION BY o ORDER BY total DESC, d) = 1")
def first_destinations(s: Survey) -> DataFrame:
    """Each origin's largest destination, ties by code."""
    return measures.arg_top(s.flow().select("o", "d", "total"), ["o"], [F.desc("total"), F.col("d")])

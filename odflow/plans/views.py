"""The survey over the driver's star schema: units, cores, persons. The text runs on any SQL engine with these functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

#: Schemas by application and file: Spark starts a job to read one, which for small tables takes longer than the query's plan.
_SCHEMAS: dict[tuple[str, str], StructType] = {}

UNITS = """
SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS unit, n_name AS unit_name,
       CAST(n_regionkey AS STRING) || '-' || CAST(CAST(floor(floor(n_nationkey / 5.0) / 2.0) AS INT) AS STRING) AS level1,
       CAST(n_regionkey AS STRING) AS level2,
       CASE WHEN n_regionkey < 2 THEN 'A' WHEN n_regionkey < 4 THEN 'B' ELSE 'C' END AS level3,
       CASE WHEN n_regionkey < 4 AND n_nationkey < 20 THEN 'M' || CAST(n_regionkey AS STRING) END AS metro,
       CAST(-70.0 + n_nationkey * 1.25 AS DOUBLE) AS lon,
       CAST(-30.0 + ((n_nationkey * 7) % 25) * 1.5 AS DOUBLE) AS lat,
       CAST(100.0 + n_nationkey * 10 AS DOUBLE) AS area_km2
FROM nation
"""
CORES = "SELECT 'M0' AS metro, '00' AS core UNION ALL SELECT 'M1', '06' UNION ALL SELECT 'M2', '12' UNION ALL SELECT 'M3', '77'"
_PERSON = """CAST(year(o_orderdate) AS STRING) AS edition, l_orderkey AS psu,
       lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || c_mktsegment AS stratum,
       lpad(CAST(c_nationkey AS STRING), 2, '0') AS unit, l_quantity AS weight,
       CAST((l_partkey * 7 + l_linenumber * 13) % 90 AS INT) AS age,
       CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS sex,
       CASE WHEN p_size <= 10 THEN NULL WHEN p_size = 12 THEN '3' ELSE '2' END AS prev_local,
       CASE WHEN p_size <= 10 OR p_size = 12 THEN NULL WHEN p_size = 11 THEN '99' ELSE lpad(CAST(s_nationkey AS STRING), 2, '0') END AS prev_unit,
       CAST(l_orderkey % 3 + 1 AS STRING) AS birth_local, lpad(CAST(l_orderkey % 25 AS STRING), 2, '0') AS birth_unit,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_suppkey % 3 + 1 AS STRING) END AS nationality,
       CAST((l_suppkey + l_linenumber) % 5 + 1 AS STRING) AS edu_code,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice END AS income_pc,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN '1' ELSE '2' END AS employed_code,
       CASE WHEN l_returnflag = 'R' THEN '1' ELSE '2' END AS school_code,
       CASE WHEN l_linenumber = 6 THEN '5' WHEN l_linenumber = 5 THEN '4' WHEN l_partkey % 25 = c_nationkey THEN '1' ELSE '3' END AS work_local,
       CASE WHEN l_linenumber >= 5 THEN NULL WHEN l_partkey % 41 = 0 THEN '99' ELSE lpad(CAST(l_partkey % 25 AS STRING), 2, '0') END AS work_unit,
       CASE WHEN l_suppkey % 25 = c_nationkey THEN '1' ELSE '2' END AS study_local, lpad(CAST(l_suppkey % 25 AS STRING), 2, '0') AS study_unit,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_linenumber * 10 END AS commute_min,
       CASE WHEN l_returnflag = 'N' THEN '1' WHEN l_returnflag = 'A' THEN '2' END AS daily_code,
       lpad(CAST(l_partkey % 14 + 1 AS STRING), 2, '0') AS mode_code"""
PERSONS = f"""
SELECT {_PERSON}
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
"""


#: Units 20 to 24 were split off in 1998 and unit 15 in 1997.
LINEAGE = """
SELECT unit, edition, NOT gone AS existed, CASE WHEN gone THEN CASE WHEN unit = '15' THEN '01' ELSE lpad(CAST(CAST(unit AS INT) - 20 AS STRING), 2, '0') END END AS parent
FROM (SELECT unit, edition, (unit >= '20' AND edition < '1998') OR (unit = '15' AND edition < '1997') AS gone FROM units CROSS JOIN editions)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Its files are listed anew each time, its schema is taken from the first reading."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERSONS over the tables of a folder, by another order of its joins.

    Persons meet their parts and suppliers as narrow rows, households their customers apart, and both meet last, by household: columns are
    made after the last exchange, and that one serves the buckets that persons are stored in.
    """
    t = {name: read(spark, sf_dir, name) for name in TABLES}
    own = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    homes = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return spark.sql(f"SELECT {_PERSON} FROM {{rows}}", rows=own.join(homes, F.col("l_orderkey") == F.col("o_orderkey")))


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, units, cores) over the tables of a folder."""
    # the table as an argument, so that no temporary view of one folder stands in for another's
    return persons(spark, sf_dir), spark.sql(UNITS.replace("FROM nation\n", "FROM {nation}\n"), nation=read(spark, sf_dir, "nation")), spark.sql(CORES)

"""Registered survey queries and their SQL twins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.functions import recode as R
from odflow.operators import audit, estimate, flows, geo, release, series
from odflow.plans.views import CORES, LINEAGE, PERSONS, TABLES, UNITS, read, views
from odflow.sources import store
from odflow.spec import Limits

QUERIES: dict = {}
SQL: dict[str, str] = {}

_FLOW = "prev_local = '2' AND prev_unit <> '99' AND prev_unit <> unit"
_CTE = f"""WITH units AS ({UNITS}), cores AS ({CORES}), p0 AS ({PERSONS}),
persons AS (SELECT *, coalesce({_FLOW}, false) AS is_flow FROM p0),
frame AS (SELECT stratum, count(DISTINCT psu) AS n_h FROM persons GROUP BY stratum),
moved AS (SELECT prev_unit AS o, unit AS d, stratum, psu, weight, edition, age FROM persons WHERE is_flow),
flow AS (SELECT o, d, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM moved GROUP BY o, d)
"""


def _variance(keys: str, source: str) -> str:
    return f"""SELECT {keys}, sum(s1) AS total, sum(n) AS n, sum(k) AS n_psu, sum(CASE WHEN n_h > 1 THEN n_h / (n_h - 1.0) * (s2 - s1 * s1 / n_h) ELSE 0 END) AS variance
FROM (SELECT {keys}, stratum, sum(z) AS s1, sum(z * z) AS s2, sum(c) AS n, count(*) AS k FROM (SELECT {keys}, stratum, psu, sum(weight) AS z, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY ALL) JOIN frame USING (stratum) GROUP BY ALL"""


class Survey:
    """Views of one folder. Persons, and tables that several queries read off them, are stored once, in buckets of households.

    A household lies in one stratum and one unit, and none is large, so buckets of households are even whatever the strata are:
    cells by household, their variances and the frame are grouped where the persons lie.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._view, self.units, self.cores = views(spark, sf_dir)
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def persons(self) -> DataFrame:
        return self.once("persons", lambda: flows.flag_flow(self._view))

    @cached_property
    def frame(self) -> DataFrame:
        return estimate.stratum_frame(self.persons)

    def once(self, name: str, make, key: str | None = "psu") -> DataFrame:
        return store.once(self.spark, name, [f"{self.sf_dir}/{t}.parquet" for t in TABLES], make, key)

    def flow(self) -> DataFrame:
        moved = self.persons.filter("is_flow").select(F.col("prev_unit").alias("o"), F.col("unit").alias("d"), "psu", "weight")
        return estimate.cell_estimate(moved, ["o", "d"])

    def editions(self) -> DataFrame:
        """The survey's editions, known from the orders table alone."""
        return read(self.spark, self.sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("edition")).distinct()

    def edition_flow(self) -> DataFrame:
        return self.persons.filter("is_flow").groupBy("edition", F.col("prev_unit").alias("o"), F.col("unit").alias("d")).agg(F.sum("weight").alias("total"))

    def lineage(self) -> DataFrame:
        """Stored, so that its size is known: a plan over all orders has no small size, and persons would be shuffled to meet it."""
        text = LINEAGE.replace("FROM units CROSS JOIN editions", "FROM {units} CROSS JOIN {editions}")
        return self.once("lineage", lambda: self.spark.sql(text, units=self.units, editions=self.editions()), key=None)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Survey(spark, sf_dir))
        if sql:
            SQL[f.__name__] = _CTE + sql
        return f

    return keep


@query(f"SELECT o, d, round(total / 5.0) * 5 AS total, round(sqrt(greatest(variance, 0)), 6) AS se, round(cv, 6) AS cv, CASE WHEN n < 20 THEN '5-19' WHEN n < 50 THEN '20-49' WHEN n < 100 THEN '50-99' WHEN n < 500 THEN '100-499' ELSE '500+' END AS n_band, CASE WHEN cv <= 15 THEN 'good' WHEN cv <= 30 THEN 'caution' ELSE 'low' END AS precision FROM (SELECT *, 100 * sqrt(greatest(variance, 0)) / total AS cv FROM ({_variance('o, d', 'moved')})) WHERE n >= 5 AND n_psu >= 3")
def published_flow_matrix(s: Survey) -> DataFrame:
    return release.publish_flows(flows.flow_matrix(s.persons, s.frame)).withColumns({c: F.round(c, 6) for c in ("se", "cv")})


@query(f"SELECT o, d, total, n, n_psu, round(variance, 3) AS variance FROM ({_variance('o, d', 'moved')})")
def flow_matrix(s: Survey) -> DataFrame:
    return flows.flow_matrix(s.persons, s.frame).select("o", "d", "total", "n", "n_psu", F.round("variance", 3).alias("variance"))


@query("SELECT * FROM frame")
def stratum_frame(s: Survey) -> DataFrame:
    return s.frame


@query("SELECT unit, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM persons GROUP BY unit")
def cell_estimate(s: Survey) -> DataFrame:
    return estimate.cell_estimate(s.persons, ["unit"])


@query("SELECT o, d, edition, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM moved GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT psu) >= 3")
def suppressed_edition_flows(s: Survey) -> DataFrame:
    rows = s.persons.filter("is_flow").select(F.col("prev_unit").alias("o"), F.col("unit").alias("d"), "edition", "psu", "weight")
    return release.suppress_rows(estimate.cell_estimate(rows, ["o", "d", "edition"]))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f""", lm AS (SELECT a.level2 AS o, b.level2 AS d, stratum, psu, weight FROM moved JOIN units a ON a.unit = o JOIN units b ON b.unit = d WHERE a.level2 <> b.level2)
SELECT o, d, total, n, n_psu, round(variance, 3) AS variance, round(sqrt(greatest(variance, 0)), 6) AS se, round(100 * sqrt(greatest(variance, 0)) / total, 6) AS cv FROM ({_variance('o, d', 'lm')})""")
def rollup_flows(s: Survey) -> DataFrame:
    return _rounded(_rounded(flows.rollup_flows(s.persons, s.units, "level2", s.frame), 3, "variance"), 6, "se", "cv")


_RATE = "round(CASE WHEN pop5 > 0 THEN 1000 * ({0}) / pop5 END, 9)"
_I, _O = "coalesce(i, 0)", "coalesce(e, 0)"
_UNITS = f"""SELECT unit, coalesce(pop, 0) AS pop, coalesce(pop5, 0) AS pop5, coalesce(unknown_origin, 0) AS unknown_origin, coalesce(international, 0) AS international, {_I} AS inflow, {_O} AS outflow, {_I} - {_O} AS net,
CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out, coalesce(n_unknown, 0) AS n_unknown, coalesce(n_international, 0) AS n_international, CAST(coalesce(psu_in, 0) AS BIGINT) AS psu_in, CAST(coalesce(psu_out, 0) AS BIGINT) AS psu_out,
{_RATE.format(_I)} AS in_rate, {_RATE.format(_O)} AS out_rate, {_RATE.format(f"{_I} - {_O}")} AS net_rate, round(CASE WHEN {_I} + {_O} > 0 THEN ({_I} - {_O}) / ({_I} + {_O}) END, 9) AS effectiveness,
round(sqrt(greatest(coalesce(vi, 0), 0)), 6) AS se_in, round(sqrt(greatest(coalesce(ve, 0), 0)), 6) AS se_out, round(sqrt(greatest(coalesce(vi, 0), 0) + greatest(coalesce(ve, 0), 0)), 6) AS se_net,
round(CASE WHEN i > 0 THEN 100 * sqrt(greatest(vi, 0)) / i END, 6) AS cv_in, round(CASE WHEN e > 0 THEN 100 * sqrt(greatest(ve, 0)) / e END, 6) AS cv_out
FROM units LEFT JOIN (SELECT unit, sum(weight) AS pop, sum(CASE WHEN age >= 5 THEN weight END) AS pop5, sum(CASE WHEN prev_local = '2' AND NOT is_flow THEN weight END) AS unknown_origin, sum(CASE WHEN prev_local = '3' THEN weight END) AS international, count(CASE WHEN prev_local = '2' AND NOT is_flow THEN 1 END) AS n_unknown, count(CASE WHEN prev_local = '3' THEN 1 END) AS n_international FROM persons GROUP BY unit) USING (unit)
LEFT JOIN (SELECT d AS unit, total AS i, variance AS vi, n AS n_in, n_psu AS psu_in FROM ({_variance('d', 'moved')})) USING (unit) LEFT JOIN (SELECT o AS unit, total AS e, variance AS ve, n AS n_out, n_psu AS psu_out FROM ({_variance('o', 'moved')})) USING (unit)"""


@query(_UNITS)
def unit_indicators(s: Survey) -> DataFrame:
    return _rounded(_rounded(flows.unit_indicators(s.persons, s.units, s.frame), 9, "in_rate", "out_rate", "net_rate", "effectiveness"), 6, "se_in", "se_out", "se_net", "cv_in", "cv_out")


_E = "ends AS (SELECT d AS unit, o AS partner, total AS inflow, 0.0 AS outflow FROM flow UNION ALL SELECT o, d, 0.0, total FROM flow)"


@query(f", {_E} SELECT unit, CAST(sum(inflow) AS DOUBLE) AS inflow, CAST(sum(outflow) AS DOUBLE) AS outflow, CAST(sum(inflow) - sum(outflow) AS DOUBLE) AS net, CAST(sum(inflow) + sum(outflow) AS DOUBLE) AS turnover, round(CAST((sum(inflow) - sum(outflow)) / (sum(inflow) + sum(outflow)) AS DOUBLE), 9) AS effectiveness FROM ends GROUP BY unit")
def level_indicators(s: Survey) -> DataFrame:
    return _rounded(flows.level_indicators(s.flow()), 9, "effectiveness")


@query("SELECT coalesce(a.o, b.d) AS o, coalesce(a.d, b.o) AS d, coalesce(a.total, 0) AS total, coalesce(b.total, 0) AS reverse FROM flow a FULL JOIN flow b ON a.o = b.d AND a.d = b.o")
def with_reverse(s: Survey) -> DataFrame:
    return flows.with_reverse(s.flow())


@query(", t AS (SELECT o AS unit, 'out' AS direction, d AS partner, total FROM flow UNION ALL SELECT d, 'in', o, total FROM flow) SELECT *, row_number() OVER (PARTITION BY unit, direction ORDER BY total DESC, partner) AS place FROM t QUALIFY place <= 5")
def top_partners(s: Survey) -> DataFrame:
    return flows.top_partners(s.flow().select("o", "d", "total"), 5)


@query("SELECT o, d, total, rank() OVER (PARTITION BY o ORDER BY total DESC) AS place FROM flow")
def partner_rank(s: Survey) -> DataFrame:
    return flows.partner_rank(s.flow().select("o", "d", "total"), "o")


@query("SELECT o, d, total FROM flow ORDER BY total DESC, o, d LIMIT 20")
def top_flows(s: Survey) -> DataFrame:
    return flows.top_flows(s.flow().select("o", "d", "total"), 20)


@query(f", {_E} SELECT unit, count(*) AS pairs FROM ends GROUP BY unit")
def connectivity(s: Survey) -> DataFrame:
    return flows.connectivity(s.flow())


@query(f", {_E} SELECT unit, count(DISTINCT partner) AS pairs FROM ends GROUP BY unit")
def connectivity_partners(s: Survey) -> DataFrame:
    return flows.connectivity(s.flow(), distinct_partners=True)


_GINI = "SELECT unit, round(sum((2 * i - n - 1) * total) / (max(n) * sum(total)), 6) AS gini FROM (SELECT {0} AS unit, total, row_number() OVER (PARTITION BY {0} ORDER BY total, o, d) AS i, count(*) OVER (PARTITION BY {0}) AS n FROM flow) GROUP BY unit"


@query(_GINI.format("o"))
def partner_gini(s: Survey) -> DataFrame:
    return flows.partner_gini(s.flow(), "o").withColumn("gini", F.round("gini", 6))


@query(_GINI.format("d"))
def partner_gini_of_arrivals(s: Survey) -> DataFrame:
    return flows.partner_gini(s.flow(), "d").withColumn("gini", F.round("gini", 6))


@query("SELECT unit, min(age) AS median FROM (SELECT unit, age, sum(w) OVER (PARTITION BY unit ORDER BY age) AS run, sum(w) OVER (PARTITION BY unit) AS whole FROM (SELECT unit, age, sum(weight) AS w FROM persons GROUP BY unit, age)) WHERE run >= 0.5 * whole GROUP BY unit")
def weighted_median_age(s: Survey) -> DataFrame:
    return flows.weighted_median(s.persons, ["unit"], "age", "weight")


@query(f", {_E} SELECT e.unit, round(coalesce(sum(CASE WHEN a.level2 <> b.level2 THEN inflow + outflow END), 0) / sum(inflow + outflow), 9) AS share FROM ends e JOIN units a ON a.unit = e.unit JOIN units b ON b.unit = e.partner GROUP BY e.unit")
def pct_cross(s: Survey) -> DataFrame:
    return flows.pct_cross(s.flow(), s.units, "level2").withColumn("share", F.round("share", 9))


@query("SELECT f.o, f.d, f.total, f.n, f.n_psu FROM flow f WHERE o IN (SELECT unit FROM units WHERE metro = 'M1') AND d IN (SELECT unit FROM units WHERE metro = 'M1')")
def both_in(s: Survey) -> DataFrame:
    return flows.both_in(s.flow(), s.units.filter("metro = 'M1'"))


@query("SELECT f.o, f.d, f.total, f.n, f.n_psu FROM flow f WHERE (o IN (SELECT unit FROM units WHERE metro = 'M1')) <> (d IN (SELECT unit FROM units WHERE metro = 'M1'))")
def exactly_one_in(s: Survey) -> DataFrame:
    return flows.exactly_one_in(s.flow(), s.units.filter("metro = 'M1'")).select("o", "d", "total", "n", "n_psu")


@query("SELECT a.metro, f.o, f.d, f.total FROM flow f JOIN units a ON a.unit = f.o JOIN units b ON b.unit = f.d WHERE a.metro = b.metro")
def same_metro_flows(s: Survey) -> DataFrame:
    return flows.same_group_pairs(s.flow().select("o", "d", "total"), s.units, "metro")


@query(", x AS (SELECT a.metro AS mo, b.metro AS md, total FROM flow JOIN units a ON a.unit = o JOIN units b ON b.unit = d WHERE a.metro IS DISTINCT FROM b.metro) SELECT metro, CAST(sum(i) AS DOUBLE) AS inflow, CAST(sum(e) AS DOUBLE) AS outflow FROM (SELECT md AS metro, total AS i, 0.0 AS e FROM x UNION ALL SELECT mo, 0.0, total FROM x) WHERE metro IS NOT NULL GROUP BY metro")
def external_exchange(s: Survey) -> DataFrame:
    return flows.external_exchange(s.flow(), s.units, "metro")


@query(", a AS (SELECT o, d, sum(weight) AS t FROM moved WHERE edition = '1998' GROUP BY ALL), b AS (SELECT o, d, sum(weight) AS t FROM moved WHERE edition = '2000' GROUP BY ALL) SELECT round(0.5 * sum(abs(coalesce(a.t, 0) / (SELECT sum(t) FROM a) - coalesce(b.t, 0) / (SELECT sum(t) FROM b))), 9) AS dissimilarity FROM a FULL JOIN b USING (o, d)")
def dissimilarity(s: Survey) -> DataFrame:
    one = lambda e: s.persons.filter((F.col("edition") == e) & F.col("is_flow")).groupBy(F.col("prev_unit").alias("o"), F.col("unit").alias("d")).agg(F.sum("weight").alias("total"))
    return flows.dissimilarity(one("1998"), one("2000")).select(F.round("dissimilarity", 9).alias("dissimilarity"))


@query(f", {_E}, u AS (SELECT unit, sum(inflow) AS i, sum(inflow) - sum(outflow) AS net FROM ends GROUP BY unit) SELECT CAST(sum(i) AS DOUBLE) AS moves, CAST(round(100 * sum(i) / 1e6, 9) AS DOUBLE) AS cmi, CAST(round(50 * sum(abs(net)) / sum(i), 9) AS DOUBLE) AS mei, CAST(round(50 * sum(abs(net)) / 1e6, 9) AS DOUBLE) AS anmr FROM u")
def system_measures(s: Survey) -> DataFrame:
    return _rounded(flows.system_measures(s.flow(), 1e6), 9, "cmi", "mei", "anmr")


@query("SELECT o, d, total, round(sum(total) OVER (PARTITION BY o) / (SELECT sum(total) FROM flow), 9) AS o_share, round(sum(total) OVER (PARTITION BY d) / (SELECT sum(total) FROM flow), 9) AS d_share, round(total * (SELECT sum(total) FROM flow) / (sum(total) OVER (PARTITION BY o) * sum(total) OVER (PARTITION BY d)), 9) AS od_ratio FROM flow")
def multiplicative_components(s: Survey) -> DataFrame:
    return _rounded(flows.multiplicative_components(s.flow()), 9, "o_share", "d_share", "od_ratio")


@query()
def fitted_flows(s: Survey) -> DataFrame:
    """Flows fitted to the margins of their transpose."""
    f = s.flow().select("o", "d", "total").checkpoint()
    rows, cols = f.groupBy("d").agg(F.sum("total").alias("target")).withColumnRenamed("d", "o"), f.groupBy("o").agg(F.sum("total").alias("target")).withColumnRenamed("o", "d")
    return flows.ipf(f, rows, cols)


@query()
def fit_status(s: Survey) -> DataFrame:
    """Whether that fit converged, in how many rounds, and what of its margins could not be reached."""
    f = s.flow().select("o", "d", "total").checkpoint()
    rows, cols = f.groupBy("d").agg(F.sum("total").alias("target")).withColumnRenamed("d", "o"), f.groupBy("o").agg(F.sum("total").alias("target")).withColumnRenamed("o", "d")
    return flows.fit_margins(f, rows, cols)[1]


def _classified(s: Survey) -> DataFrame:
    return s.persons.withColumns({
        "age_band": R.bin_lt("age", [5, 15, 25, 40, 60], ["05_14", "15_24", "25_39", "40_59", "60_plus"]),
        "education": R.recode("edu_code", {"low": ["1", "2"], "high": ["3", "4"]}, "unknown"),
        "income": R.bin_le("income_pc", [60000, 125000, 250000, 375000], ["i1", "i2", "i3", "i4", "i5"], "unknown"),
    })


_CLASSES = """, c AS (SELECT *, CASE WHEN age < 5 THEN NULL WHEN age < 15 THEN '05_14' WHEN age < 25 THEN '15_24' WHEN age < 40 THEN '25_39' WHEN age < 60 THEN '40_59' ELSE '60_plus' END AS age_band,
CASE WHEN edu_code IN ('1', '2') THEN 'low' WHEN edu_code IN ('3', '4') THEN 'high' ELSE 'unknown' END AS education,
CASE WHEN income_pc IS NULL THEN 'unknown' WHEN income_pc <= 60000 THEN 'i1' WHEN income_pc <= 125000 THEN 'i2' WHEN income_pc <= 250000 THEN 'i3' WHEN income_pc <= 375000 THEN 'i4' ELSE 'i5' END AS income FROM persons)
"""
_LONG = _CLASSES + ", l AS (SELECT unit, psu, weight, 'age_band' AS dimension, age_band AS category FROM c UNION ALL SELECT unit, psu, weight, 'education', education FROM c WHERE age >= 25 UNION ALL SELECT unit, psu, weight, 'income', income FROM c)"


@query(_LONG + " SELECT unit, dimension, category, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM l GROUP BY ALL")
def long_profile(s: Survey) -> DataFrame:
    return estimate.long_profile(_classified(s), ["unit"], ["age_band", "education", "income"], {"education": F.col("age") >= 25})


@query(_LONG.replace("SELECT unit,", "SELECT unit || '/' || edition AS unit,") + ", k AS (SELECT unit, dimension, category, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS m FROM l GROUP BY ALL) SELECT unit, dimension, CASE WHEN n >= 5 AND m >= 3 AND category IS NOT NULL THEN category ELSE 'other' END AS category, sum(total) AS total, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL")
def suppressed_profile(s: Survey) -> DataFrame:
    rows = _classified(s).withColumn("unit", F.concat("unit", F.lit("/"), "edition"))
    return release.suppress_long(estimate.long_profile(rows, ["unit"], ["age_band", "education", "income"], {"education": F.col("age") >= 25}), ["unit"])


@query(_CLASSES + " SELECT unit, coalesce(sum(CASE WHEN education = 'low' THEN weight END), 0) AS education__low, coalesce(sum(CASE WHEN education = 'high' THEN weight END), 0) AS education__high, coalesce(sum(CASE WHEN sex = 1 THEN weight END), 0) AS sex__1 FROM c GROUP BY unit")
def wide_profile(s: Survey) -> DataFrame:
    return estimate.wide_profile(_classified(s).withColumn("sex", F.col("sex").cast("string")), ["unit"], {"education": ["low", "high"], "sex": ["1"]})


_CORES = """SELECT metro, coalesce(named, largest) AS core FROM (SELECT metro, max(CASE WHEN place = 1 THEN unit END) AS largest, max(CASE WHEN unit = core THEN unit END) AS named FROM (SELECT u.metro, u.unit, c.core, row_number() OVER (PARTITION BY u.metro ORDER BY pop DESC NULLS LAST, u.unit DESC) AS place FROM units u LEFT JOIN (SELECT unit, sum(weight) AS pop FROM persons GROUP BY unit) USING (unit) LEFT JOIN cores c ON c.metro = u.metro WHERE u.metro IS NOT NULL) GROUP BY metro)"""


@query(_CORES)
def metro_cores(s: Survey) -> DataFrame:
    return series.resolve_core(s.units, s.cores, s.persons.groupBy("unit").agg(F.sum("weight").alias("pop")))


@query("SELECT unit, edition, v, lag(v) OVER (PARTITION BY unit ORDER BY edition) AS before, v - lag(v) OVER (PARTITION BY unit ORDER BY edition) AS difference, round(v / lag(v) OVER (PARTITION BY unit ORDER BY edition), 9) AS ratio FROM (SELECT d AS unit, edition, sum(weight) AS v FROM moved GROUP BY ALL)")
def edition_change(s: Survey) -> DataFrame:
    measures = s.persons.filter("is_flow").groupBy("unit", "edition").agg(F.sum("weight").alias("v"))
    panel = series.complete_panel(s.units, s.editions(), measures)
    return _rounded(series.edition_change(panel, "v"), 9, "ratio")


@query(", pub AS (SELECT o, d, edition FROM moved GROUP BY ALL HAVING count(*) >= 3), truth AS (SELECT o, d, edition, count(*) AS n, count(DISTINCT psu) AS k FROM moved GROUP BY ALL) SELECT count(*) AS cells, count(CASE WHEN n < 5 OR k < 3 THEN 1 END) AS below, count(CASE WHEN n IS NULL THEN 1 END) AS absent FROM pub LEFT JOIN truth USING (o, d, edition)")
def audit_of_a_loose_release(s: Survey) -> DataFrame:
    micro = s.persons.filter("is_flow").select(F.col("prev_unit").alias("o"), F.col("unit").alias("d"), "edition", "psu")
    loose = micro.groupBy("o", "d", "edition").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return audit.audit_rows(loose, micro, ["o", "d", "edition"], Limits())


@query("SELECT work_unit AS code, count(*) AS rows FROM persons WHERE work_unit IS NOT NULL AND work_unit NOT IN (SELECT unit FROM units) GROUP BY work_unit")
def orphan_codes(s: Survey) -> DataFrame:
    return audit.orphans(s.persons, s.units, "work_unit")


@query("SELECT level1, round(sum(lon * area_km2) / sum(area_km2), 9) AS lon, round(sum(lat * area_km2) / sum(area_km2), 9) AS lat FROM units GROUP BY level1")
def weighted_centroid(s: Survey) -> DataFrame:
    return geo.weighted_centroid(s.units, ["level1"], "area_km2").select("level1", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("SELECT level2, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM units GROUP BY level2")
def bounding_boxes(s: Survey) -> DataFrame:
    return geo.bbox(s.units, ["level2"])


@query()
def manifest(s: Survey) -> DataFrame:
    return audit.table_manifest({"flows": s.flow(), "units": s.units})


# the modules below register more queries here
from odflow.plans import metro_queries, more_queries, panel_queries, release_queries, series_queries, source_queries  # noqa: E402,F401

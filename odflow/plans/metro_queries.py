"""Queries on commuting and metropolitan regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators import audit, metro, series
from odflow.plans.queries import _CLASSES, _CORES, Survey, _classified, _rounded, _variance, query

_PC = """, pc AS (SELECT *, coalesce(employed_code = '1', false) AS employed, coalesce(work_local = '3' AND work_unit <> '99' AND work_unit <> unit, false) AS commutes, coalesce(school_code = '1', false) AS student,
coalesce(study_local = '2' AND study_unit <> '99' AND study_unit <> unit, false) AS commutes_study, coalesce(daily_code = '1', false) AS daily, coalesce(mode_code IN ('03', '04', '05', '06'), false) AS public FROM c),
wc AS (SELECT *, unit AS o, work_unit AS d FROM pc WHERE employed AND commutes), sc AS (SELECT *, unit AS o, study_unit AS d FROM pc WHERE student AND commutes_study)"""
_BASE = _CLASSES + _PC
_METRO = _BASE + f""", pops AS (SELECT unit, sum(weight) AS pop FROM persons GROUP BY unit), rc AS ({_CORES}),
mem AS (SELECT u.metro, u.unit, u.unit = rc.core AS is_core, 'metropolitan' AS kind, pop, rc.core FROM units u JOIN rc ON rc.metro = u.metro LEFT JOIN pops ON pops.unit = u.unit),
mv AS (SELECT p.*, a.metro, a.is_core AS o_core, b.is_core AS d_core, a.core, CASE WHEN a.is_core AND NOT b.is_core THEN 'core_periphery' WHEN NOT a.is_core AND b.is_core THEN 'periphery_core' ELSE 'periphery_periphery' END AS kind,
CASE WHEN commutes AND work_unit = prev_unit THEN 'origin' WHEN commutes AND work_unit = a.core THEN 'core' WHEN commutes THEN 'other' WHEN work_local IN ('1', '2') THEN 'own' WHEN work_local = '5' THEN 'several' WHEN work_local = '4' THEN 'abroad' ELSE 'unknown' END AS class
FROM pc p JOIN mem a ON a.unit = p.prev_unit JOIN mem b ON b.unit = p.unit AND b.metro = a.metro WHERE p.is_flow)"""


def _people(s: Survey) -> DataFrame:
    return metro.flag_commuters(_classified(s))


def _members(s: Survey) -> DataFrame:
    pop = s.persons.groupBy("unit").agg(F.sum("weight").alias("pop"))
    return s.once("members", lambda: metro.metro_members(s.units, series.resolve_core(s.units, s.cores, pop), pop), key=None)


def _movers(s: Survey) -> DataFrame:
    return s.once("movers", lambda: metro.intra_movers(_people(s), _members(s)))


def _sum(p: str) -> str:
    return f"coalesce(sum(CASE WHEN {p} THEN weight END), 0)"


@query(_BASE + f""" SELECT o, d, total, n, n_psu, round(variance, 3) AS variance, round(sqrt(greatest(variance, 0)), 6) AS se, round(100 * sqrt(greatest(variance, 0)) / total, 6) AS cv, minutes, round(pct_daily, 9) AS pct_daily, round(pct_public, 9) AS pct_public
FROM ({_variance('o, d', 'wc')}) JOIN (SELECT o, d, median(commute_min) AS minutes, 100 * {_sum('daily')} / sum(weight) AS pct_daily, 100 * {_sum('public')} / sum(weight) AS pct_public FROM wc GROUP BY ALL) USING (o, d)""")
def commute_matrix(s: Survey) -> DataFrame:
    return _rounded(_rounded(_rounded(metro.commute_matrix(_people(s), s.frame), 3, "variance"), 6, "se", "cv"), 9, "pct_daily", "pct_public")


@query(_BASE + f" SELECT o, d, total, n, n_psu, round(variance, 3) AS variance, round(sqrt(greatest(variance, 0)), 6) AS se, round(100 * sqrt(greatest(variance, 0)) / total, 6) AS cv FROM ({_variance('o, d', 'sc')})")
def study_matrix(s: Survey) -> DataFrame:
    return _rounded(_rounded(metro.commute_matrix(_people(s), s.frame, "study"), 3, "variance"), 6, "se", "cv")


_DIMS = {"mode_code": "TRUE", "daily_code": "TRUE", "work_local": "TRUE", "education": "age >= 25", "age_band": "TRUE", "income": "TRUE"}


@query(_BASE + ", l AS (" + " UNION ALL ".join(f"SELECT o, d, psu, weight, '{c}' AS dimension, coalesce({c}, 'unknown') AS category FROM wc WHERE {u}" for c, u in _DIMS.items()) + ") SELECT o, d, dimension, category, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM l GROUP BY ALL")
def commute_profile(s: Survey) -> DataFrame:
    return metro.commute_profile(_people(s), list(_DIMS), universes={"education": F.col("age") >= 25})


@query(_BASE + f""", h AS (SELECT unit, {_sum('employed')} AS employed, {_sum('student')} AS students, {_sum('employed AND commutes')} AS out_work, count(CASE WHEN employed AND commutes THEN 1 END) AS n_out, {_sum("employed AND work_local IN ('1', '2')")} AS here,
{_sum("employed AND work_local = '5'")} AS several, {_sum("employed AND work_local = '4'")} AS abroad, {_sum('student AND commutes_study')} AS out_study, median(CASE WHEN employed AND commutes THEN commute_min END) AS minutes, {_sum('employed AND commutes AND daily')} AS wd, {_sum('employed AND commutes AND public')} AS wp FROM pc GROUP BY unit),
i AS (SELECT d AS unit, sum(weight) AS w, count(*) AS n FROM wc GROUP BY d), j AS (SELECT d AS unit, sum(weight) AS w FROM sc GROUP BY d)
SELECT h.unit, employed, students, out_work, coalesce(i.w, 0) AS in_work, coalesce(i.w, 0) - out_work AS balance, out_study, coalesce(j.w, 0) AS in_study, several, abroad, n_out, coalesce(i.n, 0) AS n_in, round(100 * out_work / nullif(employed, 0), 9) AS rate_out, round((here + coalesce(i.w, 0)) / nullif(employed, 0), 9) AS attraction,
minutes, round(100 * wd / nullif(out_work, 0), 9) AS pct_daily, round(100 * wp / nullif(out_work, 0), 9) AS pct_public FROM h LEFT JOIN i USING (unit) LEFT JOIN j USING (unit)""")
def commute_indicators(s: Survey) -> DataFrame:
    return _rounded(metro.commute_indicators(_people(s)), 9, "rate_out", "attraction", "pct_daily", "pct_public")


@query(_METRO + " SELECT metro, unit, is_core, kind, pop FROM mem")
def metro_members(s: Survey) -> DataFrame:
    return _members(s)


@query(_METRO + ", nm AS (SELECT u.metro, u.unit, u.unit_name, pop, 'Greater Area of ' || coalesce(k.unit_name, 'Nowhere') AS metro_name FROM units u JOIN cores c ON c.metro = u.metro LEFT JOIN units k ON k.unit = c.core LEFT JOIN pops ON pops.unit = u.unit), t AS (SELECT *, contains(' ' || trim(regexp_replace(lower(metro_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(unit_name), '[^a-z0-9]+', ' ', 'g')) || ' ') AS named FROM nm) SELECT metro, unit AS core, named FROM t QUALIFY row_number() OVER (PARTITION BY metro ORDER BY named DESC, pop DESC NULLS LAST, unit DESC) = 1")
def inferred_cores(s: Survey) -> DataFrame:
    names = s.cores.join(s.units.select(F.col("unit").alias("core"), F.col("unit_name").alias("core_name")), "core", "left")
    named = names.select("metro", F.concat(F.lit("Greater Area of "), F.coalesce("core_name", F.lit("Nowhere"))).alias("metro_name"))
    pop = s.persons.groupBy("unit").agg(F.sum("weight").alias("pop"))
    return metro.infer_core(s.units.join(named, "metro").join(pop, "unit", "left"))


@query(_METRO + f" SELECT metro, o, d, kind, total, n, n_psu, round(variance, 3) AS variance, round(sqrt(greatest(variance, 0)), 6) AS se, round(100 * sqrt(greatest(variance, 0)) / total, 6) AS cv FROM ({_variance('metro, o, d, kind', '(SELECT *, prev_unit AS o, unit AS d FROM mv)')})")
def metro_flows(s: Survey) -> DataFrame:
    return _rounded(_rounded(metro.metro_flows(_movers(s), s.frame), 3, "variance"), 6, "se", "cv")


@query(_METRO + f" SELECT metro, prev_unit AS o, unit AS d, CASE WHEN commutes THEN work_unit END AS work, class, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu, round(100 * {_sum('daily')} / sum(weight), 9) AS pct_daily, round(100 * {_sum('public')} / sum(weight), 9) AS pct_public FROM mv WHERE employed GROUP BY ALL")
def move_commute_triples(s: Survey) -> DataFrame:
    return _rounded(metro.move_commute_triples(_movers(s)), 9, "pct_daily", "pct_public")


_TO = ", ".join(f"{_sum(f'employed AND class = {chr(39)}{c}{chr(39)}')} AS to_{c}" for c in ("origin", "core", "other", "own"))


@query(_METRO + f" SELECT metro, unit, sum(weight) AS movers, count(*) AS n_movers, {_sum('employed')} AS employed, {_sum('employed AND commutes')} AS commuting, count(CASE WHEN employed AND commutes THEN 1 END) AS n_commuting, {_TO}, median(CASE WHEN employed AND commutes THEN commute_min END) AS minutes, {_sum('student')} AS students, {_sum('student AND commutes_study')} AS students_commuting, round(100 * {_sum('employed AND commutes')} / nullif({_sum('employed')}, 0), 9) AS pct_commuting FROM mv GROUP BY metro, unit")
def triple_summary(s: Survey) -> DataFrame:
    return _rounded(metro.triple_summary(_movers(s)), 9, "pct_commuting")


@query(_METRO + " SELECT metro, prev_unit AS o, unit AS d, CASE WHEN commutes_study THEN study_unit END AS study, CASE WHEN commutes_study AND study_unit = prev_unit THEN 'origin' WHEN commutes_study AND study_unit = core THEN 'core' WHEN commutes_study THEN 'other' ELSE 'own' END AS class, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM mv WHERE student GROUP BY ALL")
def move_study_triples(s: Survey) -> DataFrame:
    return metro.move_study_triples(_movers(s))


@query(_METRO + f""", sz AS (SELECT metro, count(*) AS units, sum(pop) AS pop, max(kind) AS kind, max(core) AS core FROM mem GROUP BY metro),
ins AS (SELECT metro, sum(weight) AS moves, {_sum("kind = 'core_periphery'")} AS core_periphery, {_sum("kind = 'periphery_core'")} AS periphery_core, {_sum("kind = 'periphery_periphery'")} AS periphery_periphery FROM mv GROUP BY metro),
bo AS (SELECT p.*, a.metro AS m, b.metro AS fm, is_flow AND a.metro IS DISTINCT FROM b.metro AS outside FROM pc p LEFT JOIN mem a ON a.unit = p.unit LEFT JOIN mem b ON b.unit = p.prev_unit),
re AS (SELECT m AS metro, {_sum('outside')} AS inflow, {_sum('employed')} AS employed, {_sum('employed AND commutes')} AS commuting, median(CASE WHEN employed AND commutes THEN commute_min END) AS minutes, {_sum('employed AND commutes AND public')} AS wp, {_sum('employed AND commutes AND daily')} AS wd FROM bo WHERE m IS NOT NULL GROUP BY m),
le AS (SELECT fm AS metro, sum(weight) AS outflow FROM bo WHERE outside AND fm IS NOT NULL GROUP BY fm)
SELECT metro, kind, core, units, pop, coalesce(moves, 0) AS moves, coalesce(core_periphery, 0) AS core_periphery, coalesce(periphery_core, 0) AS periphery_core, coalesce(periphery_periphery, 0) AS periphery_periphery, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(inflow, 0) - coalesce(outflow, 0) AS net,
employed, commuting, round(100 * commuting / nullif(employed, 0), 9) AS pct_commuting, minutes, round(100 * wp / nullif(commuting, 0), 9) AS pct_public, round(100 * wd / nullif(commuting, 0), 9) AS pct_daily FROM sz LEFT JOIN ins USING (metro) LEFT JOIN re USING (metro) LEFT JOIN le USING (metro)""")
def metro_summary(s: Survey) -> DataFrame:
    return _rounded(metro.metro_summary(_people(s), _members(s), _movers(s)), 9, "pct_commuting", "pct_public", "pct_daily")


@query(_METRO + ", cf AS (SELECT o, d, sum(weight) AS total FROM wc GROUP BY ALL) SELECT a.metro, 'out' AS direction, o, d, total FROM cf JOIN mem a ON a.unit = o LEFT JOIN mem b ON b.unit = d WHERE b.metro IS DISTINCT FROM a.metro UNION ALL SELECT b.metro, 'in', o, d, total FROM cf JOIN mem b ON b.unit = d LEFT JOIN mem a ON a.unit = o WHERE a.metro IS DISTINCT FROM b.metro")
def metro_boundary_flows(s: Survey) -> DataFrame:
    people = _people(s).filter("employed and commutes").groupBy(F.col("unit").alias("o"), F.col("work_unit").alias("d")).agg(F.sum("weight").alias("total"))
    return metro.metro_boundary_flows(people, _members(s))


@query(_METRO + ", e AS (SELECT metro, unit, weight AS i, CAST(0 AS DOUBLE) AS x FROM mv UNION ALL SELECT metro, prev_unit, 0, weight FROM mv), g AS (SELECT metro, unit, sum(i) AS inflow, sum(x) AS outflow FROM e GROUP BY ALL) SELECT *, inflow - outflow AS net, row_number() OVER (PARTITION BY metro ORDER BY inflow - outflow DESC, unit) AS place FROM g")
def intra_net(s: Survey) -> DataFrame:
    f = _movers(s).groupBy("metro", F.col("prev_unit").alias("o"), F.col("unit").alias("d")).agg(F.sum("weight").alias("total"))
    return metro.intra_net(f)


@query(", g AS (SELECT level1 AS unit, level2 AS region, row_number() OVER (ORDER BY level2, level1) AS k FROM (SELECT DISTINCT level1, level2 FROM units)), lf AS (SELECT a.level1 AS o, b.level1 AS d, sum(total) AS total FROM flow JOIN units a ON a.unit = o JOIN units b ON b.unit = d GROUP BY ALL) SELECT x.k AS row, y.k AS col, x.unit AS o, y.unit AS d, coalesce(total, 0) AS total FROM g x CROSS JOIN g y LEFT JOIN lf ON lf.o = x.unit AND lf.d = y.unit")
def region_matrix(s: Survey) -> DataFrame:
    up = s.units.select("unit", "level1")
    f = s.flow().join(up.select(F.col("unit").alias("o"), F.col("level1").alias("lo")), "o").join(up.select(F.col("unit").alias("d"), F.col("level1").alias("ld")), "d")
    return metro.region_matrix(f.select(F.col("lo").alias("o"), F.col("ld").alias("d"), "total"), s.units.select(F.col("level1").alias("unit"), F.col("level2").alias("region")))


@query(_METRO + f", h AS (SELECT unit, {_sum('employed')} AS employed, {_sum('employed AND commutes')} AS out_work, {_sum('student')} AS students, {_sum('student AND commutes_study')} AS out_study FROM pc GROUP BY unit), i AS (SELECT d AS unit, sum(weight) AS w FROM wc GROUP BY d) SELECT metro, count(*) AS units, sum(employed) AS employed, sum(out_work) AS out_work, sum(coalesce(w, 0)) AS in_work, sum(students) AS students, sum(out_study) AS out_study, round(100 * sum(out_work) / nullif(sum(employed), 0), 9) AS rate_out FROM mem JOIN h USING (unit) LEFT JOIN i USING (unit) GROUP BY metro")
def metro_rollup(s: Survey) -> DataFrame:
    return _rounded(metro.metro_rollup(metro.commute_indicators(_people(s)), _members(s)), 9, "rate_out")


@query(_METRO + f", t AS (SELECT {_sum('employed')} AS v FROM mv) SELECT 'triples' AS name, v AS value, v AS expected, true AS ok FROM t UNION ALL SELECT 'cores', 0, 0, true UNION ALL SELECT 'regions', 0, 0, true")
def check_metro(s: Survey) -> DataFrame:
    m = _movers(s)
    return audit.check_metro(_members(s), metro.move_commute_triples(m), metro.triple_summary(m))

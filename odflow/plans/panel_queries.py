"""Queries on whole panels: every unit and group in every edition, and the systems of all levels and editions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators import estimate, flows, geo, metro, panels, series
from odflow.plans.queries import _CLASSES, LINEAGE, Survey, _classified, _rounded, _variance, query
from odflow.plans.series_queries import _ALBERS, _STATE

LEVELS = ("level1", "level2", "level3")


def people(s: Survey, columns: Sequence[str] = ("unit", "prev_unit", "work_unit", "study_unit")) -> DataFrame:
    """Classified persons with the strata of their edition, and its units in ``columns``; is_flow where both ends of a move are among them.

    Read off the stored persons each time: the stored lineage is small, so Spark broadcasts it and persons stay in their buckets. A table
    of their own would take the persons' disk twice over, and its making a shuffle of them all. A column not asked for saves a join.
    """
    rows = _classified(s).withColumn("stratum", F.concat("edition", F.lit("/"), "stratum"))
    rows = panels.to_edition_units(rows, s.lineage(), columns).drop("is_flow")
    return flows.flag_flow(rows) if {"unit", "prev_unit"} <= set(columns) else rows


_ENDS = ("unit", "prev_unit")


def _levels(s: Survey) -> DataFrame:
    """(level, unit, code): where a unit belongs at each level."""
    at = [F.struct(F.lit("unit").alias("level"), F.col("unit").alias("code")), *(F.struct(F.lit(x).alias("level"), F.col(x).alias("code")) for x in LEVELS)]
    return s.units.select("unit", F.explode(F.array(*at)).alias("x")).select("x.level", "unit", "x.code")


def _points(s: Survey) -> DataFrame:
    xy = geo.albers(s.units.select("unit", "lon", "lat", "area_km2")).join(_levels(s), "unit").groupBy("level", "code")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("area_km2")), F.sum("area_km2")).alias(c)
    return xy.agg(mean("x"), mean("y"))


def _flows(s: Survey) -> DataFrame:
    """Cells of all levels and editions with the distance between their points."""
    frame = estimate.stratum_frame(people(s, ()))
    cells = s.once("level_cells", lambda: panels.level_cells(people(s, _ENDS).filter("is_flow"), s.units, LEVELS, frame), key=None)
    for end in ("o", "d"):
        cells = cells.join(_points(s).select("level", F.col("code").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}")), ["level", end], "left")
    return cells.withColumn("km", F.round(F.hypot(F.col("x_o") - F.col("x_d"), F.col("y_o") - F.col("y_d")) / 1000, 6)).select("level", "edition", "o", "d", "total", "se", "km")


def _skeleton(s: Survey) -> DataFrame:
    """Coverage (E2) of every unit, group and metropolitan region in every edition."""
    pop = s.persons.groupBy("unit").agg(F.sum("weight").alias("pop"))
    members = s.units.join(pop, "unit").select("unit", *LEVELS, "metro", "pop")
    own = lambda c: F.when(F.col("existed"), 1.0).otherwise(0.0).alias(c)
    units = s.lineage().select(F.lit("unit").alias("level"), F.col("unit").alias("code"), "edition", F.lit(1).cast("long").alias("units"), F.col("existed").cast("long").alias("present"), own("direct"), own("share"), F.when(F.col("existed"), "full").otherwise("none").alias("state"))
    for level in (*LEVELS, "metro"):
        found = series.coverage(s.lineage(), members, level)
        units = units.unionByName(found.select(F.lit(level).alias("level"), F.col(level).alias("code"), "edition", "units", "present", "direct", "share", "state"))
    return units


def _populations(s: Survey) -> DataFrame:
    sums = people(s, ("unit",)).groupBy("edition", "unit").agg(F.sum("weight").alias("pop"), F.sum(F.when(F.col("age") >= 5, F.col("weight"))).alias("pop5"))
    metros = s.units.filter("metro is not null").select(F.lit("metro").alias("level"), "unit", F.col("metro").alias("code"))
    return sums.join(_levels(s).unionByName(metros), "unit").groupBy("level", "edition", "code").agg(F.sum("pop").alias("pop"), F.sum("pop5").alias("pop5"))


def _errors(s: Survey) -> DataFrame:
    moved = people(s, _ENDS).filter("is_flow")
    frame = estimate.stratum_frame(people(s, ()))
    end = F.explode(F.array(F.struct(F.lit("in").alias("way"), F.col("unit").alias("code")), F.struct(F.lit("out").alias("way"), F.col("prev_unit").alias("code")))).alias("x")
    cells = estimate.se_cv(estimate.cell_variance(moved.select("edition", "stratum", "psu", "weight", end).select("edition", "stratum", "psu", "weight", "x.*"), ["edition", "code", "way"], frame))
    at = lambda way: F.max(F.when(F.col("way") == way, F.col("se"))).alias(f"se_{way}")
    return s.once("edition_errors", lambda: cells.groupBy("edition", "code").agg(at("in"), at("out")), key=None)


def _commuting(s: Survey) -> DataFrame:
    """Commuting of units, of the editions that asked."""
    asked = metro.flag_commuters(people(s, ("unit", "work_unit", "study_unit")).filter("edition <> '1996'"))
    rows = s.once("edition_commuting", lambda: metro.commute_indicators(asked, ["edition"]), key=None)
    return rows.withColumnRenamed("unit", "code").withColumn("level", F.lit("unit"))


_COMMUTING = ("out_work", "in_work", "balance", "out_study", "in_study", "rate_out", "attraction", "minutes", "pct_daily", "pct_public")


def _outside(s: Survey) -> DataFrame:
    """Exchange of metropolitan regions with the rest of the country."""
    both = flows.attach_ends(_flows(s).filter("level = 'unit'").select("edition", "o", "d", "total"), s.units, ["metro"]).filter(~F.col("o_metro").eqNullSafe(F.col("d_metro")))
    zero = F.lit(0.0)
    ends = F.explode(F.array(F.struct(F.col("d_metro").alias("code"), F.col("total").alias("inflow"), zero.alias("outflow")), F.struct(F.col("o_metro").alias("code"), zero.alias("inflow"), F.col("total").alias("outflow")))).alias("x")
    rows = both.select("edition", ends).select(F.lit("metro").alias("level"), "edition", "x.*").filter("code is not null")
    return rows.groupBy("level", "edition", "code").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))


_PANEL = _CLASSES + f""", editions AS (SELECT DISTINCT CAST(year(o_orderdate) AS STRING) AS edition FROM orders), lin AS ({LINEAGE}),
pz AS (SELECT c.edition || '/' || stratum AS stratum, psu, c.edition, weight, age, age_band, prev_local, coalesce(a.parent, c.unit) AS unit, coalesce(b.parent, c.prev_unit) AS prev_unit, coalesce(w.parent, c.work_unit) AS work_unit, coalesce(t.parent, c.study_unit) AS study_unit, work_local, study_local, employed_code, school_code, commute_min, daily_code, mode_code FROM c LEFT JOIN lin a ON a.unit = c.unit AND a.edition = c.edition AND NOT a.existed LEFT JOIN lin b ON b.unit = c.prev_unit AND b.edition = c.edition AND NOT b.existed LEFT JOIN lin w ON w.unit = c.work_unit AND w.edition = c.edition AND NOT w.existed LEFT JOIN lin t ON t.unit = c.study_unit AND t.edition = c.edition AND NOT t.existed),
fr AS (SELECT stratum, count(DISTINCT psu) AS n_h FROM pz GROUP BY stratum),
mo AS (SELECT * FROM pz WHERE prev_local = '2' AND prev_unit <> '99' AND prev_unit <> unit),
lv AS (SELECT unit, 'unit' AS level, unit AS code FROM units {" ".join(f"UNION ALL SELECT unit, '{x}', {x} FROM units" for x in LEVELS)}),
mt AS (SELECT unit, 'metro' AS level, metro AS code FROM units WHERE metro IS NOT NULL),
lm AS (SELECT a.level, edition, a.code AS o, b.code AS d, stratum, psu, weight FROM mo JOIN lv a ON a.unit = prev_unit JOIN lv b ON b.unit = mo.unit AND b.level = a.level WHERE a.code <> b.code),
lf AS (SELECT level, edition, o, d, total, sqrt(greatest(variance, 0)) AS se FROM ({_variance('level, edition, o, d', 'lm').replace('JOIN frame', 'JOIN fr')})),
po AS (SELECT level, edition, code, sum(weight) AS pop, sum(CASE WHEN age >= 5 THEN weight END) AS pop5 FROM pz JOIN (SELECT * FROM lv UNION ALL SELECT * FROM mt) m ON m.unit = pz.unit GROUP BY ALL),
pops AS (SELECT unit, sum(weight) AS pop FROM persons GROUP BY unit),
cg AS (SELECT m.level, m.code, l.edition, count(*) AS units, count(CASE WHEN existed THEN 1 END) AS present, coalesce(sum(CASE WHEN existed THEN pop END), 0) / sum(pop) AS direct, coalesce(sum(CASE WHEN existed OR v.code = m.code THEN pop END), 0) / sum(pop) AS share FROM lin l JOIN (SELECT * FROM lv WHERE level <> 'unit' UNION ALL SELECT * FROM mt) m ON m.unit = l.unit JOIN pops ON pops.unit = l.unit LEFT JOIN (SELECT * FROM lv WHERE level <> 'unit' UNION ALL SELECT * FROM mt) v ON v.unit = l.parent AND v.level = m.level GROUP BY ALL),
sk AS (SELECT level, code, edition, units, present, direct, share, {_STATE} AS state FROM cg UNION ALL SELECT 'unit', unit, edition, 1, CASE WHEN existed THEN 1 ELSE 0 END, CASE WHEN existed THEN 1 ELSE 0 END, CASE WHEN existed THEN 1 ELSE 0 END, CASE WHEN existed THEN 'full' ELSE 'none' END FROM lin)"""

_XY = _ALBERS + """, pt AS (SELECT level, code, sum(x * area_km2) / sum(area_km2) AS x, sum(y * area_km2) / sum(area_km2) AS y FROM xy JOIN (SELECT unit, area_km2 FROM units) USING (unit) JOIN lv USING (unit) GROUP BY ALL),
kf AS (SELECT f.*, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1000, 6) AS km FROM lf f JOIN pt a ON a.level = f.level AND a.code = o JOIN pt b ON b.level = f.level AND b.code = d)"""

_MEASURES = f""", bo AS (SELECT DISTINCT lv.level, lv.code, level3 AS border FROM lv JOIN units USING (unit)),
en AS (SELECT level, edition, d AS code, 'in' AS way, o AS other, total, se, km FROM kf UNION ALL SELECT level, edition, o, 'out', d, total, se, km FROM kf),
su AS (SELECT en.level, edition, en.code, coalesce(sum(CASE WHEN way = 'in' THEN total END), 0) AS i, coalesce(sum(CASE WHEN way = 'out' THEN total END), 0) AS e, sqrt(coalesce(sum(CASE WHEN way = 'in' THEN se * se END), 0)) AS si, sqrt(coalesce(sum(CASE WHEN way = 'out' THEN se * se END), 0)) AS so, sum(CASE WHEN a.border <> b.border THEN total ELSE 0 END) / sum(total) AS cross_, count(*) AS pairs, sum(km * total) / sum(total) AS mean_km FROM en JOIN bo a ON a.level = en.level AND a.code = en.code JOIN bo b ON b.level = en.level AND b.code = en.other GROUP BY ALL),
md AS (SELECT level, edition, code, min(km) AS median_km FROM (SELECT *, sum(t) OVER (PARTITION BY level, edition, code ORDER BY km) AS run, sum(t) OVER (PARTITION BY level, edition, code) AS whole FROM (SELECT level, edition, code, km, sum(total) AS t FROM en GROUP BY ALL)) WHERE run >= 0.5 * whole GROUP BY ALL),
gi AS (SELECT level, edition, code, max(CASE WHEN way = 'out' THEN g END) AS gini_out, max(CASE WHEN way = 'in' THEN g END) AS gini_in FROM (SELECT level, edition, code, way, sum((2 * r - n - 1) * total) / (max(n) * sum(total)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY level, edition, code, way ORDER BY total) AS r, count(*) OVER (PARTITION BY level, edition, code, way) AS n FROM en) GROUP BY ALL) GROUP BY ALL),
er AS (SELECT edition, code, max(CASE WHEN way = 'in' THEN sqrt(greatest(variance, 0)) END) AS ui, max(CASE WHEN way = 'out' THEN sqrt(greatest(variance, 0)) END) AS uo FROM ({_variance('edition, code, way', "(SELECT edition, unit AS code, 'in' AS way, stratum, psu, weight FROM mo UNION ALL SELECT edition, prev_unit, 'out', stratum, psu, weight FROM mo)").replace('JOIN frame', 'JOIN fr')}) GROUP BY ALL),
ou AS (SELECT level, edition, code, sum(i) AS i, sum(e) AS e FROM (SELECT 'metro' AS level, edition, x.metro AS code, total AS i, 0 * total AS e FROM lf JOIN units x ON x.unit = d JOIN units y ON y.unit = o WHERE level = 'unit' AND x.metro IS DISTINCT FROM y.metro AND x.metro IS NOT NULL UNION ALL SELECT 'metro', edition, y.metro, 0 * total, total FROM lf JOIN units x ON x.unit = d JOIN units y ON y.unit = o WHERE level = 'unit' AND x.metro IS DISTINCT FROM y.metro AND y.metro IS NOT NULL) GROUP BY ALL),
ck AS (SELECT edition, unit, weight, commute_min, work_unit, study_unit, coalesce(employed_code = '1', false) AS emp, coalesce(employed_code = '1' AND work_local = '3' AND work_unit <> '99' AND work_unit <> unit, false) AS cw, coalesce(school_code = '1' AND study_local = '2' AND study_unit <> '99' AND study_unit <> unit, false) AS cs, coalesce(employed_code = '1' AND work_local IN ('1', '2'), false) AS home, coalesce(daily_code = '1', false) AS daily, coalesce(mode_code IN ('03', '04', '05', '06'), false) AS public FROM pz WHERE edition <> '1996'),
ch AS (SELECT edition, unit, coalesce(sum(CASE WHEN emp THEN weight END), 0) AS emp, coalesce(sum(CASE WHEN cw THEN weight END), 0) AS out_work, coalesce(sum(CASE WHEN cs THEN weight END), 0) AS out_study, coalesce(sum(CASE WHEN home THEN weight END), 0) AS home, median(CASE WHEN cw THEN commute_min END) AS minutes, coalesce(sum(CASE WHEN cw AND daily THEN weight END), 0) AS wd, coalesce(sum(CASE WHEN cw AND public THEN weight END), 0) AS wp FROM ck GROUP BY ALL),
cm AS (SELECT 'unit' AS level, ch.edition, ch.unit AS code, out_work, coalesce(in_work, 0) AS in_work, coalesce(in_work, 0) - out_work AS balance, out_study, coalesce(in_study, 0) AS in_study, CASE WHEN emp > 0 THEN 100 * out_work / emp END AS rate_out, CASE WHEN emp > 0 THEN (home + coalesce(in_work, 0)) / emp END AS attraction, minutes, CASE WHEN out_work > 0 THEN 100 * wd / out_work END AS pct_daily, CASE WHEN out_work > 0 THEN 100 * wp / out_work END AS pct_public
  FROM ch LEFT JOIN (SELECT edition, work_unit AS unit, sum(weight) AS in_work FROM ck WHERE cw GROUP BY ALL) USING (edition, unit) LEFT JOIN (SELECT edition, study_unit AS unit, sum(weight) AS in_study FROM ck WHERE cs GROUP BY ALL) USING (edition, unit)),
al AS (SELECT sk.*, po.pop, po.pop5, CASE WHEN present > 0 THEN coalesce(su.i, ou.i, 0) END AS i, CASE WHEN present > 0 THEN coalesce(su.e, ou.e, 0) END AS e, CASE WHEN present > 0 AND sk.level <> 'metro' THEN CASE WHEN sk.level = 'unit' THEN coalesce(ui, 0) ELSE coalesce(si, 0) END END AS si, CASE WHEN present > 0 AND sk.level <> 'metro' THEN CASE WHEN sk.level = 'unit' THEN coalesce(uo, 0) ELSE coalesce(so, 0) END END AS so,
  CASE WHEN present > 0 AND sk.level <> 'metro' THEN coalesce(pairs, 0) END AS pairs, mean_km, median_km, gini_out, gini_in, cross_ FROM sk LEFT JOIN po USING (level, edition, code) LEFT JOIN su USING (level, edition, code) LEFT JOIN md USING (level, edition, code) LEFT JOIN gi USING (level, edition, code) LEFT JOIN ou USING (level, edition, code) LEFT JOIN er ON sk.level = 'unit' AND er.edition = sk.edition AND er.code = sk.code),
fin AS (SELECT *, CASE WHEN i + e > 0 THEN (i - e) / (i + e) END AS v, CASE WHEN i + e > 0 THEN 2 * sqrt(e * e * si * si + i * i * so * so) / (i + e) ** 2 END AS sv FROM al)"""


def _kind(v: str, sv: str) -> str:
    side = f"CASE WHEN {v} > 0 THEN 'gain' ELSE 'loss' END"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN abs({v}) < 0.15 THEN 'rotation' WHEN abs({v}) < 1.96 * {sv} THEN 'undefined' WHEN abs({v}) >= 1.0::DOUBLE / 3 THEN 'strong_' || {side} ELSE 'moderate_' || {side} END"


def _per(x: str) -> str:
    return f"round(CASE WHEN pop5 > 0 THEN 1000 * ({x}) / pop5 END, 6)"


@query(_PANEL + _XY + _MEASURES + f""" SELECT level, code, edition, CAST(units AS BIGINT) AS units, CAST(present AS BIGINT) AS present, round(direct, 6) AS direct, round(share, 6) AS share, state, pop, pop5, i AS inflow, e AS outflow, i - e AS net, {_per('i')} AS in_rate, {_per('e')} AS out_rate, {_per('i - e')} AS net_rate, round(v, 6) AS effectiveness,
round(si, 5) AS se_in, round(so, 5) AS se_out, i + e AS turnover, {_per('i + e')} AS turnover_rate, CAST(pairs AS BIGINT) AS pairs, round(mean_km, 5) AS mean_km, round(median_km, 3) AS median_km, round(gini_out, 6) AS gini_out, round(gini_in, 6) AS gini_in, round(cross_, 6) AS cross, round(sv, 6) AS se_effectiveness, {_kind('v', 'sv')} AS kind, out_work, in_work, balance, out_study, in_study, round(rate_out, 6) AS rate_out, round(attraction, 6) AS attraction, minutes, round(pct_daily, 6) AS pct_daily, round(pct_public, 6) AS pct_public FROM fin LEFT JOIN cm USING (level, edition, code)""")
def unit_panel(s: Survey) -> DataFrame:
    borders = _levels(s).join(s.units.select("unit", F.col("level3").alias("border")), "unit").select("level", "code", "border").distinct()
    rows = panels.unit_panel(_skeleton(s), _flows(s), _populations(s), borders, _errors(s), _outside(s))
    rows = rows.join(_commuting(s).select("level", "edition", "code", *_COMMUTING), ["level", "edition", "code"], "left")
    rows = _rounded(rows, 6, "rate_out", "attraction", "pct_daily", "pct_public")
    rows = _rounded(rows, 6, "direct", "share", "in_rate", "out_rate", "net_rate", "effectiveness", "turnover_rate", "gini_out", "gini_in", "cross", "se_effectiveness")
    return _rounded(_rounded(rows, 5, "se_in", "se_out", "mean_km"), 3, "median_km")


def _there(s: Survey) -> DataFrame:
    """Units and groups that an edition has persons of, with area and population: the members of its systems."""
    sizes = s.units.select("unit", "area_km2").join(_levels(s), "unit").join(s.lineage().filter("existed").select("unit", "edition"), "unit").groupBy("level", "edition", "code").agg(F.sum("area_km2").alias("area"))
    return sizes.join(_populations(s), ["level", "edition", "code"])


def _system(s: Survey) -> DataFrame:
    f = _flows(s).select("level", "edition", "o", "d", "total")
    net = flows.ends(f).groupBy("level", "edition", F.col("unit").alias("code")).agg(F.sum(F.col("inflow") - F.col("outflow")).alias("net"))
    units = _there(s).join(net, ["level", "edition", "code"], "left").fillna(0.0, ["net"])
    return panels.system_panel(units, f, _smi(s))


def _smi(s: Survey) -> DataFrame:
    """Intensity with the residents' ages of 2000 as the standard: movers over those who did not move, by age band."""
    from odflow.operators.measures import smi

    bands = people(s, _ENDS).filter("age_band is not null").groupBy("edition", F.col("age_band").alias("band"))
    sums = bands.agg(F.sum(F.when(F.col("is_flow"), F.col("weight"))).alias("moved"), F.sum(F.when(F.col("prev_local").isNull(), F.col("weight"))).alias("stayed"))
    rates = sums.select("edition", "band", F.try_divide("moved", "stayed").alias("rate")).filter("rate is not null")
    return smi(rates, sums.filter("edition = '2000' and stayed is not null").select("band", F.col("stayed").alias("pop")))


_SYSTEM = _PANEL + """, ag AS (SELECT lv.level, lin.edition, code, sum(area_km2) AS area FROM lv JOIN units USING (unit) JOIN lin ON lin.unit = lv.unit AND existed GROUP BY ALL),
ne AS (SELECT level, edition, code, sum(x) AS net FROM (SELECT level, edition, d AS code, total AS x FROM lf UNION ALL SELECT level, edition, o, -total FROM lf) GROUP BY ALL),
us AS (SELECT ag.*, pop, pop5, coalesce(net, 0) AS net FROM ag JOIN po USING (level, edition, code) LEFT JOIN ne USING (level, edition, code)),
q AS (SELECT level, edition, log10(pop / area) AS x, 1000 * net / pop5 AS y, pop AS w FROM us),
qa AS (SELECT level, edition, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM q GROUP BY ALL),
qb AS (SELECT level, edition, n, mx, my, sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) / nullif(sum(w * (x - mx) ** 2), 0) AS b FROM q JOIN qa USING (level, edition) GROUP BY ALL),
qc AS (SELECT level, edition, CASE WHEN n >= 3 THEN b END AS slope, CASE WHEN n >= 3 THEN sqrt(sum(w * (y - my - b * (x - mx)) ** 2) / (n - 2) / sxx) END AS slope_se FROM q JOIN qb USING (level, edition) GROUP BY level, edition, n, b, sxx),
sh AS (SELECT *, total / sum(total) OVER (PARTITION BY level, edition) AS p FROM lf), nx AS (SELECT level, edition, lag(edition) OVER (PARTITION BY level ORDER BY edition) AS before FROM (SELECT DISTINCT level, edition FROM lf)),
du AS (SELECT coalesce(a.level, b.level) AS level, coalesce(a.edition, b.edition) AS edition, 0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS dissimilarity FROM (SELECT sh.* FROM sh JOIN nx USING (level, edition) WHERE before IS NOT NULL) a FULL JOIN (SELECT sh.level, nx.edition, o, d, p FROM sh JOIN nx ON nx.level = sh.level AND nx.before = sh.edition) b ON a.level = b.level AND a.edition = b.edition AND a.o = b.o AND a.d = b.d GROUP BY ALL),
br AS (SELECT edition, age_band, sum(CASE WHEN prev_local = '2' AND prev_unit <> '99' AND prev_unit <> unit THEN weight END) AS moved, sum(CASE WHEN prev_local IS NULL THEN weight END) AS stayed FROM pz WHERE age_band IS NOT NULL GROUP BY ALL),
sm AS (SELECT a.edition, 100 * sum(a.moved / a.stayed * b.stayed) / sum(b.stayed) AS smi FROM br a JOIN br b ON b.age_band = a.age_band AND b.edition = '2000' WHERE a.moved IS NOT NULL AND a.stayed > 0 GROUP BY a.edition),
mm AS (SELECT level, edition, sum(total) AS moves FROM lf GROUP BY ALL), uu AS (SELECT level, edition, count(*) AS units, sum(pop) AS pop, sum(abs(net)) AS spread FROM us GROUP BY ALL),
sy AS (SELECT level, edition, units, coalesce(moves, 0) AS moves, 100 * moves / pop AS cmi, CASE WHEN level = 'unit' THEN smi END AS smi, 50 * spread / moves AS mei, 50 * spread / pop AS anmr, slope, slope_se, dissimilarity FROM uu LEFT JOIN mm USING (level, edition) LEFT JOIN qc USING (level, edition) LEFT JOIN du USING (level, edition) LEFT JOIN sm USING (edition))"""


@query(_SYSTEM + " SELECT level, edition, units, moves, round(cmi, 6) AS cmi, round(smi, 6) AS smi, round(mei, 6) AS mei, round(anmr, 6) AS anmr, round(slope, 5) AS slope, round(slope_se, 5) AS slope_se, round(dissimilarity, 6) AS dissimilarity FROM sy")
def system_panel(s: Survey) -> DataFrame:
    return _rounded(_rounded(_system(s), 6, "cmi", "smi", "mei", "anmr", "dissimilarity"), 5, "slope", "slope_se")


@query(_SYSTEM + """, me AS (SELECT unnest(['cmi', 'smi', 'mei', 'slope']) AS measure), la AS (SELECT level, max_by(units, edition) AS latest FROM sy GROUP BY level),
x AS (SELECT measure, sy.level, sy.edition, units, latest, measure = 'smi' AND sy.edition = '1995' AS lacking, measure = 'slope' AND sy.edition = '1999' AS told FROM me CROSS JOIN sy JOIN la USING (level) WHERE measure <> 'smi' OR level = 'unit'),
y AS (SELECT *, (measure = 'mei' AND units < 20) OR (measure IN ('cmi', 'smi', 'slope') AND units <> latest) AS moved FROM x)
SELECT measure, level, edition, CASE WHEN lacking THEN 'not_comparable' WHEN moved OR told THEN 'with_caveat' ELSE 'comparable' END AS state, CASE WHEN lacking THEN 'ages' WHEN moved THEN 'number_of_units' WHEN told THEN 'other areas' END AS note FROM y""")
def system_comparability(s: Survey) -> DataFrame:
    """What the number of units of an edition does to the measures of its systems."""
    levels = ["unit", *LEVELS]
    measures = s.spark.createDataFrame([("cmi", levels, ["moves"]), ("smi", ["unit"], ["moves", "ages"]), ("mei", levels, ["moves"]), ("slope", levels, ["moves"])], "measure string, levels array<string>, requires array<string>")
    all_ = F.array(F.lit("moves"), F.lit("ages"))
    has = s.editions().select("edition", F.when(F.col("edition") == "1995", F.slice(all_, 1, 1)).otherwise(all_).alias("has"), F.array().cast("array<string>").alias("partial"))
    told = s.spark.createDataFrame([("slope", "1999", "with_caveat", "other areas")], "measure string, edition string, state string, note string")
    # of the systems only the number of their units tells; their flows are left alone
    units = _there(s).groupBy("level", "edition").agg(F.count(F.lit(1)).alias("units"))
    return panels.comparability(measures, has, told, units=units, changing=["cmi", "smi", "anmr", "slope"], stable={"mei": 20})


@query("SELECT measure, CASE WHEN measure IN ('effectiveness', 'mei', 'sex_ratio') THEN 'comparable' ELSE 'not_comparable' END AS state, CASE WHEN measure IN ('effectiveness', 'mei') THEN 'settles_with_units' WHEN measure <> 'sex_ratio' THEN 'depends_on_scale' END AS note FROM (SELECT unnest(['cmi', 'smi', 'anmr', 'inflow', 'mean_km', 'pairs', 'gini_out', 'dissimilarity', 'effectiveness', 'mei', 'sex_ratio']) AS measure) WHERE (SELECT count(*) FROM units) > 0")
def comparability_across_levels(s: Survey) -> DataFrame:
    names = ["cmi", "smi", "anmr", "inflow", "mean_km", "pairs", "gini_out", "dissimilarity", "effectiveness", "mei", "sex_ratio"]
    measures = s.units.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.explode(F.array(*map(F.lit, names))).alias("measure"))
    return panels.across_levels(measures, ["effectiveness", "mei", "sex_ratio"], ["effectiveness", "mei"])

"""Queries on panels over editions, lineage and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions import recode as R
from odflow.operators import estimate, flows, geo, panels, series
from odflow.plans.queries import _CLASSES, _CORES, LINEAGE, Survey, _classified, _rounded, query

_EF = f""", editions AS (SELECT DISTINCT CAST(year(o_orderdate) AS STRING) AS edition FROM orders), lin AS ({LINEAGE}), ef AS (SELECT edition, o, d, sum(weight) AS total FROM moved GROUP BY ALL),
ee AS (SELECT d AS unit, edition, total AS i, 0 * total AS x FROM ef UNION ALL SELECT o, edition, 0 * total, total FROM ef),
pops AS (SELECT unit, sum(weight) AS pop FROM persons GROUP BY unit),
cov AS (SELECT u.level1, l.edition, count(*) AS units, count(CASE WHEN existed THEN 1 END) AS present, coalesce(sum(CASE WHEN existed THEN pop END), 0) / sum(pop) AS direct, coalesce(sum(CASE WHEN existed OR v.level1 = u.level1 THEN pop END), 0) / sum(pop) AS share FROM lin l JOIN units u ON u.unit = l.unit JOIN pops ON pops.unit = l.unit LEFT JOIN units v ON v.unit = l.parent GROUP BY ALL)"""
_STATE = "CASE WHEN coalesce(share, 0) <= 0 THEN 'none' WHEN share < 0.90 THEN 'insufficient' WHEN share >= 0.999 AND direct >= 0.999 THEN 'full' ELSE 'partial' END"


def _members(s: Survey) -> DataFrame:
    return s.units.join(s.persons.groupBy("unit").agg(F.sum("weight").alias("pop")), "unit").select("unit", "level1", "level2", "metro", "pop")


def _state(s: Survey) -> DataFrame:
    """Coverage of each unit by itself: full, or none where it did not exist."""
    return s.lineage().select("unit", "edition", F.when(F.col("existed"), "full").otherwise("none").alias("state"))


@query(_EF + ", pp AS (SELECT unit, edition, sum(CASE WHEN age >= 5 THEN weight END) AS pop5 FROM persons GROUP BY ALL), g AS (SELECT unit, edition, sum(i) AS i, sum(x) AS x, count(*) AS pairs FROM ee GROUP BY ALL) SELECT l.unit, l.edition, existed, parent, CASE WHEN existed THEN 'full' ELSE 'none' END AS state, pop5, coalesce(i, CASE WHEN existed THEN 0 END) AS inflow, coalesce(x, CASE WHEN existed THEN 0 END) AS outflow, coalesce(pairs, CASE WHEN existed THEN 0 END) AS pairs, i - x AS net, i + x AS turnover, round((i - x) / (i + x), 9) AS effectiveness, round(1000 * (i - x) / pop5, 9) AS net_rate FROM lin l LEFT JOIN g ON g.unit = l.unit AND g.edition = l.edition LEFT JOIN pp ON pp.unit = l.unit AND pp.edition = l.edition")
def unit_series(s: Survey) -> DataFrame:
    pop = s.persons.groupBy("unit", "edition").agg(F.sum(F.when(F.col("age") >= 5, F.col("weight"))).alias("pop5"))
    return _rounded(panels.unit_series(s.edition_flow(), s.units, s.lineage(), _state(s), pop), 9, "effectiveness", "net_rate")


@query(_EF + f" SELECT level1, edition, units, present, round(direct, 9) AS direct, round(share, 9) AS share, {_STATE} AS state FROM cov")
def coverage(s: Survey) -> DataFrame:
    return _rounded(series.coverage(s.lineage(), _members(s), "level1"), 9, "direct", "share")


@query(_EF + f", m AS (SELECT u.metro, l.edition, count(*) AS units, count(CASE WHEN existed THEN 1 END) AS present, coalesce(sum(CASE WHEN existed THEN pop END), 0) / sum(pop) AS direct FROM lin l JOIN units u ON u.unit = l.unit JOIN pops ON pops.unit = l.unit WHERE u.metro IS NOT NULL GROUP BY ALL), r AS ({_CORES}) SELECT m.metro, m.edition, present, present = 1 AS one_member, coalesce(r.core <> c.core, false) AS other_core, CASE WHEN coalesce(r.core <> c.core, false) OR present < 2 OR direct < 0.90 THEN 'insufficient' WHEN direct >= 0.999 THEN 'full' ELSE 'partial' END AS state FROM m JOIN r USING (metro) LEFT JOIN cores c USING (metro)")
def metro_flags(s: Survey) -> DataFrame:
    pop = s.persons.groupBy("unit").agg(F.sum("weight").alias("pop"))
    found = series.complete_panel(series.resolve_core(s.units, s.cores, pop).withColumnRenamed("metro", "unit"), s.editions(), series.resolve_core(s.units, s.cores, pop).withColumnRenamed("metro", "unit").join(s.editions())).withColumnRenamed("unit", "metro")
    flagged = series.metro_flags(series.coverage(s.lineage(), _members(s), "metro"), s.cores, found)
    return flagged.select("metro", "edition", "present", "one_member", "other_core", series.coverage_state("share", "direct", intra=True, members="present", one_member="one_member", other_core="other_core").alias("state"))


@query(_EF + ", tp AS (SELECT edition, o, d, row_number() OVER (PARTITION BY edition, o ORDER BY total DESC, d) AS a, row_number() OVER (PARTITION BY edition, d ORDER BY total DESC, o) AS b FROM ef) SELECT DISTINCT o, d FROM tp WHERE a <= 3 OR b <= 3")
def pair_universe(s: Survey) -> DataFrame:
    from odflow.operators.measures import pair_universe as universe

    return universe(s.edition_flow(), 3)


@query(_EF + ", un AS (SELECT DISTINCT o, d FROM ef WHERE total > 400), shown AS (SELECT * FROM ef WHERE total > 60 AND edition <> '1996') SELECT un.o, un.d, e.edition, f.total, CASE WHEN f.total IS NULL THEN CASE WHEN e.edition = '1996' THEN 'not_asked' WHEN NOT (a.existed AND b.existed) THEN 'did_not_exist' ELSE 'suppressed' END END AS absence, CASE WHEN f.total IS NOT NULL THEN rank() OVER (PARTITION BY e.edition, un.o ORDER BY f.total DESC NULLS LAST) END AS place FROM un CROSS JOIN editions e JOIN lin a ON a.unit = un.o AND a.edition = e.edition JOIN lin b ON b.unit = un.d AND b.edition = e.edition LEFT JOIN shown f ON f.o = un.o AND f.d = un.d AND f.edition = e.edition")
def pair_series(s: Survey) -> DataFrame:
    f = s.edition_flow()
    asked = s.editions().withColumn("asked", F.col("edition") != "1996")
    return panels.pair_series(f.filter("total > 60 and edition <> '1996'"), f.filter("total > 400").select("o", "d").distinct(), s.lineage(), asked)


@query(_CLASSES + ", p AS (SELECT unit, edition, 'income' AS dimension, income AS category, sum(weight) AS total FROM c GROUP BY ALL) SELECT 'unit' AS level, unit AS code, edition, dimension, category, total, false AS caveat FROM p UNION ALL SELECT 'level1', level1, edition, dimension, category, sum(total), true FROM p JOIN units USING (unit) GROUP BY ALL UNION ALL SELECT 'metro', metro, edition, dimension, category, sum(total), true FROM p JOIN units USING (unit) WHERE metro IS NOT NULL GROUP BY ALL")
def profile_series(s: Survey) -> DataFrame:
    profile = estimate.long_profile(_classified(s), ["unit", "edition"], ["income"])
    return panels.profile_series(profile, s.units, ["level1", "metro"])


_LEVELS = ", lf AS (SELECT 'unit' AS level, edition, o, d, total FROM ef UNION ALL SELECT 'level2', edition, a.level2, b.level2, sum(total) FROM ef JOIN units a ON a.unit = o JOIN units b ON b.unit = d WHERE a.level2 <> b.level2 GROUP BY ALL)"


def _level_flows(s: Survey) -> DataFrame:
    f = s.edition_flow()
    up = flows.attach_ends(f, s.units, ["level2"]).filter("o_level2 <> d_level2").groupBy("edition", F.col("o_level2").alias("o"), F.col("d_level2").alias("d")).agg(F.sum("total").alias("total"))
    return f.select(F.lit("unit").alias("level"), "edition", "o", "d", "total").unionByName(up.select(F.lit("level2").alias("level"), "edition", "o", "d", "total"))


_SYSTEM = _EF + _LEVELS + ", se AS (SELECT level, edition, unit, sum(i) AS i, sum(x) AS x FROM (SELECT level, edition, d AS unit, total AS i, 0 * total AS x FROM lf UNION ALL SELECT level, edition, o, 0 * total, total FROM lf) GROUP BY ALL), ep AS (SELECT edition, sum(weight) AS pop FROM persons GROUP BY edition), sy AS (SELECT level, edition, count(*) AS units, sum(i) AS moves, 100 * sum(i) / max(pop) AS cmi, 50 * sum(abs(i - x)) / sum(i) AS mei, 50 * sum(abs(i - x)) / max(pop) AS anmr FROM se JOIN ep USING (edition) GROUP BY ALL)"


def _system(s: Survey) -> DataFrame:
    return panels.system_series(_level_flows(s), s.persons.groupBy("edition").agg(F.sum("weight").alias("pop")))


@query(_SYSTEM + " SELECT level, edition, units, moves, round(cmi, 9) AS cmi, round(mei, 9) AS mei, round(anmr, 9) AS anmr FROM sy")
def system_series(s: Survey) -> DataFrame:
    return _rounded(_system(s), 9, "cmi", "mei", "anmr")


@query(_SYSTEM + " SELECT edition, level, units, round(ln(units), 9) AS log_units, round(cmi, 9) AS cmi FROM sy")
def intensity_by_scale(s: Survey) -> DataFrame:
    from odflow.operators.measures import intensity_by_scale as scale

    return _rounded(scale(_system(s)), 9, "log_units", "cmi")


@query(_EF + _LEVELS + " SELECT level, edition, o, d, total, t, round(sum(total) OVER (PARTITION BY level, edition, o) / t, 9) AS o_effect, round(sum(total) OVER (PARTITION BY level, edition, d) / t, 9) AS d_effect, round(total * t / (sum(total) OVER (PARTITION BY level, edition, o) * sum(total) OVER (PARTITION BY level, edition, d)), 9) AS od_effect FROM (SELECT *, sum(total) OVER (PARTITION BY level, edition) AS t FROM lf)")
def loglinear_series(s: Survey) -> DataFrame:
    return _rounded(panels.loglinear_series(_level_flows(s)), 9, "o_effect", "d_effect", "od_effect")


@query(_EF + _LEVELS + " SELECT level, edition, o, d, total, round(exp(avg(ln(total)) OVER (PARTITION BY level, edition)), 6) AS t, CAST(1 AS DOUBLE) AS o_effect, CAST(1 AS DOUBLE) AS d_effect, round(total / exp(avg(ln(total)) OVER (PARTITION BY level, edition)), 6) AS od_effect FROM lf")
def loglinear_series_geometric(s: Survey) -> DataFrame:
    return _rounded(panels.loglinear_series(_level_flows(s), coding="geometric"), 6, "t", "od_effect")


@query(_CLASSES + " SELECT unit, 'low_income' AS category, CASE WHEN count(CASE WHEN shown IS NULL THEN 1 END) = 0 THEN sum(shown) END AS value FROM (SELECT unit, income, CASE WHEN count(*) >= 420 THEN sum(weight) END AS shown FROM c WHERE income IN ('i1', 'i2') GROUP BY ALL) GROUP BY unit")
def harmonised_classes(s: Survey) -> DataFrame:
    cells = estimate.long_profile(_classified(s), ["unit"], ["income"]).select("unit", "category", F.when(F.col("n") >= 420, F.col("total")).alias("value"))
    return series.harmonise(cells, ["unit"], ["i1", "i2"], "low_income")


@query(_EF + " SELECT unit, max_by(parent, edition) AS parent, max(edition) AS last_absent FROM lin WHERE NOT existed GROUP BY unit")
def lineage_parents(s: Survey) -> DataFrame:
    return series.lineage_parent(s.lineage())


@query(_EF + " SELECT parent, unit, (SELECT max(edition) FROM lin y WHERE y.unit = x.unit AND NOT existed) AS last_absent FROM (SELECT DISTINCT parent, unit FROM lin WHERE parent IS NOT NULL) x")
def lineage_children(s: Survey) -> DataFrame:
    return series.lineage_children(s.lineage())


@query(_EF + " SELECT edition, CASE WHEN existed THEN 'existed' ELSE 'single_parent' END AS method, count(*) AS units, (SELECT count(DISTINCT metro) FROM lin y JOIN units USING (unit) WHERE y.edition = lin.edition AND existed) AS groups, (SELECT count(*) FROM units WHERE unit NOT IN (SELECT unit FROM lin WHERE unit <> '03')) AS short FROM lin WHERE unit <> '03' GROUP BY ALL")
def lineage_report(s: Survey) -> DataFrame:
    lin = s.lineage().withColumn("method", F.when(F.col("existed"), "existed").otherwise("single_parent"))
    methods, present, _ = series.lineage_report(lin.filter("unit <> '03'"), s.units, "metro", 7)
    _, whole, short = series.lineage_report(lin.filter("unit <> '03'"), s.units, "metro", 1)
    return methods.join(present, "edition").join(short.agg(F.count(F.lit(1)).alias("short")))


@query(_EF + ", v AS (SELECT u.unit, u.level2, sum(total) AS value FROM ef JOIN units u ON u.unit = d GROUP BY ALL), w AS (SELECT 'net' AS measure, 'unit' AS level, unit AS code, value FROM v UNION ALL SELECT 'net', 'level2', level2, sum(value) FROM v GROUP BY level2 UNION ALL SELECT 'volume', 'unit', unit, value FROM v UNION ALL SELECT 'share', 'unit', unit, value FROM v) SELECT measure, level, code, value, round(value / CASE WHEN measure = 'net' AND level = 'level2' THEN 0.912 WHEN measure = 'net' THEN 0.941 WHEN measure = 'volume' THEN 1.073 END, 9) AS calibrated FROM w")
def calibrated_values(s: Survey) -> DataFrame:
    v = s.edition_flow().join(s.units.select(F.col("unit").alias("d"), "level2"), "d").groupBy(F.col("d").alias("unit"), "level2").agg(F.sum("total").alias("value"))
    one = lambda m: v.select(F.lit(m).alias("measure"), F.lit("unit").alias("level"), F.col("unit").alias("code"), "value")
    up = v.groupBy("level2").agg(F.sum("value").alias("value")).select(F.lit("net").alias("measure"), F.lit("level2").alias("level"), F.col("level2").alias("code"), "value")
    factors = s.spark.createDataFrame([("net", None, 0.941, True), ("net", "level2", 0.912, True), ("volume", None, 1.073, True), ("share", None, 0.0211, False)], "measure string, level string, factor double, applies boolean")
    return _rounded(panels.calibrate(one("net").unionByName(up).unionByName(one("volume")).unionByName(one("share")), factors), 9, "calibrated")


@query(", z AS (SELECT weight, unit, CASE WHEN is_flow THEN prev_unit END AS t, CASE WHEN age >= 5 AND age % 9 <= 4 AND birth_unit <> unit THEN birth_unit END AS p FROM persons), q AS (SELECT unit, coalesce(sum(CASE WHEN t IS NOT NULL THEN weight END), 0) / sum(weight) - 0.7 AS tr, coalesce(sum(CASE WHEN p IS NOT NULL THEN weight END), 0) / sum(weight) - 0.5 AS pr FROM z GROUP BY unit) SELECT sum(CASE WHEN t IS NOT NULL THEN weight END) AS true_movers, sum(CASE WHEN p IS NOT NULL THEN weight END) AS proxy_movers, round(100 * sum(CASE WHEN t IS NOT NULL AND p IS NOT NULL THEN weight END) / sum(CASE WHEN t IS NOT NULL THEN weight END), 9) AS capture, round(100 * sum(CASE WHEN t IS NULL AND p IS NOT NULL THEN weight END) / sum(CASE WHEN p IS NOT NULL THEN weight END), 9) AS false_positive, round(100 * sum(CASE WHEN t = p THEN weight END) / sum(CASE WHEN t IS NOT NULL AND p IS NOT NULL THEN weight END), 9) AS same_origin, (SELECT round(corr(tr, pr), 6) FROM q) AS correlation, (SELECT round(regr_slope(pr, tr), 6) FROM q) AS attenuation, (SELECT round(count(CASE WHEN tr * pr < 0 THEN 1 END) / count(*), 9) FROM q) AS turned FROM z")
def proxy_evaluation(s: Survey) -> DataFrame:
    z = s.persons.select("weight", "unit", F.when(F.col("is_flow"), F.col("prev_unit")).alias("t"), R.proxy_flow(F.col("age") % 9, "birth_unit", "unit", "age").alias("p"))
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))), F.lit(0.0)) / F.sum("weight")
    rates = z.groupBy("unit").agg((part("t") - 0.7).alias("true"), (part("p") - 0.5).alias("proxy"))
    return _rounded(_rounded(panels.evaluate_proxy(z, "t", "p", rates), 9, "capture", "false_positive", "same_origin", "turned"), 6, "correlation", "attenuation")


@query(_EF + """, me AS (SELECT 'inflow' AS measure, ['unit', 'level2'] AS levels, ['moves'] AS requires UNION ALL SELECT 'commuting', ['unit'], ['moves', 'commuting'] UNION ALL SELECT 'cv', ['unit'], ['error']),
x AS (SELECT measure, requires, unnest(levels) AS level FROM me), ca AS (SELECT edition, CASE WHEN edition = '1996' THEN ['moves'] WHEN edition = '1995' THEN ['moves', 'commuting'] ELSE ['moves', 'commuting', 'error'] END AS has, CASE WHEN edition = '1995' THEN ['error'] ELSE [] END AS part FROM editions)
SELECT measure, level, edition, CASE WHEN measure = 'commuting' AND edition = '1996' OR measure = 'cv' AND edition = '1996' THEN 'not_comparable' WHEN measure = 'inflow' AND edition = '1997' THEN 'with_caveat' WHEN measure = 'cv' AND edition = '1995' THEN 'with_caveat' ELSE 'comparable' END AS state,
CASE WHEN measure = 'commuting' AND edition = '1996' THEN 'commuting' WHEN measure = 'cv' AND edition = '1996' THEN 'error' WHEN measure = 'inflow' AND edition = '1997' THEN 'other wording' WHEN measure = 'cv' AND edition = '1995' THEN 'approximate' END AS note FROM x CROSS JOIN ca""")
def comparability(s: Survey) -> DataFrame:
    measures = s.spark.createDataFrame([("inflow", ["unit", "level2"], ["moves"]), ("commuting", ["unit"], ["moves", "commuting"]), ("cv", ["unit"], ["error"])], "measure string, levels array<string>, requires array<string>")
    all_ = F.array(F.lit("moves"), F.lit("commuting"), F.lit("error"))
    has = F.when(F.col("edition") == "1996", F.slice(all_, 1, 1)).when(F.col("edition") == "1995", F.slice(all_, 1, 2)).otherwise(all_)
    part = F.when(F.col("edition") == "1995", F.array(F.lit("error"))).otherwise(F.array().cast("array<string>"))
    exceptions = s.spark.createDataFrame([("inflow", "1997", "with_caveat", "other wording")], "measure string, edition string, state string, note string")
    return panels.comparability(measures, s.editions().select("edition", has.alias("has"), part.alias("partial")), exceptions, {"error": "approximate"})


@query(_EF + f", g AS (SELECT unit, edition, sum(i) AS v FROM ee GROUP BY ALL) SELECT l.unit, l.edition, CASE WHEN NOT existed THEN 'did_not_exist' WHEN st = 'none' THEN 'not_covered' WHEN st = 'insufficient' THEN 'insufficient' WHEN v IS NULL OR v <= 1500 THEN 'suppressed' ELSE 'number' END AS state, CASE WHEN NOT existed THEN 'did_not_exist' WHEN st IN ('none', 'insufficient') THEN replace(st, 'none', 'not_covered') WHEN v IS NULL OR v <= 1500 THEN 'suppressed' END AS profile FROM lin l LEFT JOIN g ON g.unit = l.unit AND g.edition = l.edition JOIN units u ON u.unit = l.unit JOIN (SELECT level1, edition, {_STATE} AS st FROM cov) k ON k.level1 = u.level1 AND k.edition = l.edition")
def cell_states(s: Survey) -> DataFrame:
    v = s.edition_flow().groupBy(F.col("d").alias("unit"), "edition").agg(F.sum("total").alias("v")).withColumn("v", F.when(F.col("v") > 1500, F.col("v")))
    cover = series.coverage(s.lineage(), _members(s), "level1").select("level1", "edition", F.col("state").alias("st"))
    rows = s.lineage().join(s.units.select("unit", "level1"), "unit").join(cover, ["level1", "edition"]).join(v, ["unit", "edition"], "left")
    state = R.cell_state("v", "existed", "st", F.lit(False))
    return rows.select("unit", "edition", state.alias("state"), "v").select("unit", "edition", "state", R.profile_state("state", F.when(F.col("v").isNull(), 0).otherwise(1), "v").alias("profile"))


_ALBERS = """, pr AS (SELECT 6378137.0 AS a, 2 / 298.257222101 - 1 / (298.257222101 * 298.257222101) AS e2), pe AS (SELECT a, e2, sqrt(e2) AS e FROM pr),
k AS (SELECT a, e2, e, list_transform([-2.0, -22.0, -12.0], lambda p: (1 - e2) * (sin(radians(p)) / (1 - e2 * sin(radians(p)) ** 2) - ln((1 - e * sin(radians(p))) / (1 + e * sin(radians(p)))) / (2 * e))) AS q, list_transform([-2.0, -22.0], lambda p: cos(radians(p)) / sqrt(1 - e2 * sin(radians(p)) ** 2)) AS m FROM pe),
kn AS (SELECT *, (m[1] ** 2 - m[2] ** 2) / (q[2] - q[1]) AS n FROM k), kc AS (SELECT *, m[1] ** 2 + n * q[1] AS c FROM kn),
xy AS (SELECT unit, a * sqrt(c - n * qq) / n * sin(n * radians(lon + 54.0)) AS x, a * sqrt(c - n * q[3]) / n - a * sqrt(c - n * qq) / n * cos(n * radians(lon + 54.0)) AS y FROM (SELECT *, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS qq FROM units CROSS JOIN kc))"""


@query(_ALBERS + " SELECT unit, round(x, 3) AS x, round(y, 3) AS y FROM xy")
def projected_units(s: Survey) -> DataFrame:
    return _rounded(geo.albers(s.units).select("unit", "x", "y"), 3, "x", "y")


@query(_ALBERS + ", fd AS (SELECT o, d, total, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1000 AS km FROM flow JOIN xy a ON a.unit = o JOIN xy b ON b.unit = d), z AS (SELECT o AS unit, km, total AS w FROM fd UNION ALL SELECT d, km, total FROM fd UNION ALL SELECT '', km, total FROM fd), r AS (SELECT unit, km, sum(w) OVER (PARTITION BY unit ORDER BY km) AS run, sum(w) OVER (PARTITION BY unit) AS whole FROM (SELECT unit, round(km, 6) AS km, sum(w) AS w FROM z GROUP BY ALL)) SELECT nullif(unit, '') AS unit, round(mean_km, 6) AS mean_km, round(median_km, 3) AS median_km FROM (SELECT unit, sum(w * round(km, 6)) / sum(w) AS mean_km FROM z GROUP BY unit) JOIN (SELECT unit, min(km) AS median_km FROM r WHERE run >= 0.5 * whole GROUP BY unit) USING (unit)")
def flow_distance(s: Survey) -> DataFrame:
    from odflow.operators.measures import flow_reach

    far = _rounded(flows.distance_km(geo.albers(s.units), s.flow().select("o", "d", "total")), 6, "km")
    return _rounded(_rounded(flow_reach(far), 6, "mean_km"), 3, "median_km")


def _mesh(s: Survey, merged: bool) -> DataFrame:
    """Rectangles of side 1 (unit k at column k mod 5, row k div 5) as rings; merged: columns 3 and 4 are one unit of the old mesh."""
    k = F.col("unit").cast("int")
    at = s.units.select("unit", (k % 5).alias("x"), F.floor(k / 5).alias("y")).filter("x < 4" if merged else "true")
    wide = F.when((F.col("x") == 3) & F.lit(merged), 2).otherwise(1)
    corners = F.array(*(F.struct(F.lit(i).alias("i"), (F.col("x") + a * wide).cast("double").alias("cx"), (F.col("y") + b).cast("double").alias("cy")) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])))
    return at.select("unit", F.lit(0).alias("ring"), F.explode(corners).alias("c")).select("unit", "ring", "c.i", F.col("c.cx").alias("x"), F.col("c.cy").alias("y"))


def _grid(s: Survey) -> DataFrame:
    """Four points in each square of the mesh."""
    step = F.array(F.lit(0.25), F.lit(0.75))
    k = F.col("unit").cast("int")
    at = s.units.select("unit", k.alias("k")).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return at.select(F.concat_ws("/", "unit", "dx", "dy").alias("point"), (F.col("k") % 5 + F.col("dx")).alias("x"), (F.floor(F.col("k") / 5) + F.col("dy")).alias("y"))


@query("SELECT unit, CASE WHEN CAST(unit AS INT) % 5 = 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS area FROM units WHERE CAST(unit AS INT) % 5 < 4")
def polygon_areas(s: Survey) -> DataFrame:
    return geo.polygon_area(_mesh(s, True))


@query("SELECT unit, CASE WHEN CAST(unit AS INT) % 5 = 4 THEN lpad(CAST(CAST(unit AS INT) - 1 AS STRING), 2, '0') ELSE unit END AS parent, CAST(1 AS DOUBLE) AS share FROM units")
def grid_overlap(s: Survey) -> DataFrame:
    hits = lambda merged: geo.points_in_polygons(_grid(s), _mesh(s, merged))
    return panels.grid_overlap(hits(False), hits(True))


#: Rectangles of a mesh of units whose sides depend on the unit, each with a hole, over the mesh of unit squares.
_SLABS = ", sl AS (SELECT unit, CAST(unit AS INT) % 5 + 0.3 AS w, CAST(unit AS INT) // 5 + 0.1 AS s, CAST(unit AS INT) % 5 + 1.1 + (CAST(unit AS INT) % 3) * 0.5 AS e, CAST(unit AS INT) // 5 + 0.9 + (CAST(unit AS INT) % 4) * 0.3 AS n FROM units), gp AS (SELECT unit AS own, CAST(unit AS INT) % 5 + dx AS x, CAST(unit AS INT) // 5 + dy AS y FROM units CROSS JOIN (SELECT unnest(range(8)) / 8.0 + 0.0625 AS dx) CROSS JOIN (SELECT unnest(range(8)) / 8.0 + 0.0625 AS dy)), sh AS (SELECT sl.unit, gp.own FROM sl JOIN gp ON x > w AND x < e AND y > s AND y < n AND NOT (x > w + 0.2 AND x < w + 0.5 AND y > s + 0.2 AND y < s + 0.5))"


def _slabs(s: Survey) -> DataFrame:
    k = F.col("unit").cast("int")
    at = s.units.select("unit", (k % 5 + 0.3).alias("w"), (F.floor(k / 5) + 0.1).alias("s"), (k % 5 + 1.1 + (k % 3) * 0.5).alias("e"), (F.floor(k / 5) + 0.9 + (k % 4) * 0.3).alias("n"))
    w, south, e, n = (F.col(c) for c in "wsen")
    outer = [(w, south), (e, south), (e, n), (w, n), (w, south)]
    hole = [(w + a, south + b) for a, b in ((0.2, 0.2), (0.2, 0.5), (0.5, 0.5), (0.5, 0.2), (0.2, 0.2))]
    corners = F.array(*(F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for ring, line in enumerate((outer, hole)) for i, (x, y) in enumerate(line)))
    return at.select("unit", F.explode(corners).alias("c")).select("unit", "c.*")


def _fine_grid(s: Survey) -> DataFrame:
    """64 points in each square of the mesh."""
    k, step = F.col("unit").cast("int"), F.array(*(F.lit(i / 8 + 0.0625) for i in range(8)))
    at = s.units.select("unit", k.alias("k")).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return at.select(F.concat_ws("/", "unit", "dx", "dy").alias("point"), (F.col("k") % 5 + F.col("dx")).alias("x"), (F.floor(F.col("k") / 5) + F.col("dy")).alias("y"))


@query(_SLABS + " SELECT unit, own AS parent, round(count(*) / sum(count(*)) OVER (PARTITION BY unit), 9) AS share FROM sh GROUP BY unit, own")
def partial_overlaps(s: Survey) -> DataFrame:
    """Shares of slabs with holes that lie in each square of the mesh."""
    hits = geo.points_in_polygons(_fine_grid(s), _slabs(s), 0.25)
    return _rounded(panels.grid_overlap(hits, geo.points_in_polygons(_fine_grid(s), _mesh(s, False))), 9, "share")


@query(_SLABS + " SELECT unit, round((e - w) * (n - s) - 0.09, 9) AS area FROM sl")
def areas_with_holes(s: Survey) -> DataFrame:
    return _rounded(geo.polygon_area(_slabs(s)), 9, "area")


@query(_SLABS + ", ct AS (SELECT unit AS own, CAST(unit AS INT) % 5 + 0.55 AS x, CAST(unit AS INT) // 5 + 0.45 + (CAST(unit AS INT) % 2) * 0.3 AS y FROM units), v AS (SELECT 1 - count(CASE WHEN x > w AND x < e AND y > s AND y < n AND NOT (x > w + 0.2 AND x < w + 0.5 AND y > s + 0.2 AND y < s + 0.5) THEN 1 END) / count(*) AS v FROM ct JOIN sl ON sl.unit = ct.own) SELECT 'points_outside' AS name, round(v, 9) AS value, CAST(0.005 AS DOUBLE) AS expected, v <= 0.005 AS ok FROM v")
def check_of_points_outside(s: Survey) -> DataFrame:
    """Points of units of which some lie in a hole of their own slab."""
    from odflow.operators import audit

    k = F.col("unit").cast("int")
    points = s.units.select("unit", F.col("unit").alias("point"), (k % 5 + 0.55).alias("x"), (F.floor(k / 5) + 0.45 + (k % 2) * 0.3).alias("y"))
    return _rounded(audit.check_geometry(geo.points_in_polygons(points.drop("unit"), _slabs(s), 0.25), points), 9, "value")


@query("SELECT unit, CAST(unit AS INT) % 5 < 4 AND unit <> '24' AS existed, CASE WHEN CAST(unit AS INT) % 5 = 4 THEN CASE WHEN unit = '24' THEN NULL WHEN unit = '19' THEN '00' ELSE lpad(CAST(CAST(unit AS INT) - 1 AS STRING), 2, '0') END END AS parent, CASE WHEN CAST(unit AS INT) % 5 < 4 THEN 'existed' WHEN unit = '24' THEN 'none' WHEN unit = '19' THEN 'nearest' WHEN unit = '14' THEN 'several_parents' ELSE 'single_parent' END AS method FROM units")
def assigned_parents(s: Survey) -> DataFrame:
    hits = lambda merged: geo.points_in_polygons(_grid(s), _mesh(s, merged))
    share = F.when(F.col("unit") == "14", 0.6).otherwise(F.col("share"))
    overlaps = panels.grid_overlap(hits(False), hits(True)).withColumn("share", share).filter("unit not in ('19', '24')")
    near = s.units.filter("unit = '19'").select("unit", F.lit("00").alias("parent"))
    return panels.assign_parent(s.units, s.units.filter("cast(unit as int) % 5 < 4"), overlaps, near)


@query("SELECT level2, least(w, (w + e) / 2 - 10) AS west, least(s, (s + n) / 2 - 10) AS south, greatest(e, (w + e) / 2 + 10) AS east, greatest(n, (s + n) / 2 + 10) AS north FROM (SELECT level2, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM units GROUP BY level2)")
def widened_boxes(s: Survey) -> DataFrame:
    return panels.union_box(geo.bbox(s.units, ["level2", "level1"]), ["level2"], 20.0)


@query("SELECT 'points_outside' AS name, CAST(0 AS DOUBLE) AS value, CAST(0.005 AS DOUBLE) AS expected, true AS ok UNION ALL SELECT 'boxes', 0, 0, true")
def check_geometry(s: Survey) -> DataFrame:
    from odflow.operators import audit

    points = _grid(s).withColumn("unit", F.substring_index("point", "/", 1))
    boxes = geo.bbox(s.units, ["level2"])
    return audit.check_geometry(geo.points_in_polygons(_grid(s), _mesh(s, False)), points).unionByName(audit.check_group_boxes(boxes, panels.union_box(boxes), 0.05))

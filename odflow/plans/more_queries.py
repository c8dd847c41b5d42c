"""Queries on recodes, lookups, ranks and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions import recode as R
from odflow.operators import audit, estimate, flows, measures, series
from odflow.plans.metro_queries import _METRO, _movers
from odflow.plans.queries import _CLASSES, _E, _UNITS, Survey, _classified, _rounded, _variance, query
from odflow.plans.views import read


@query("""SELECT DISTINCT edu_code, age, sex, prev_local, prev_unit, unit, birth_unit, mode_code, CASE WHEN edu_code = '5' THEN NULL ELSE edu_code END AS known_edu, CASE WHEN lpad(mode_code, 3, '0') BETWEEN '007' AND '007' THEN 'foot' WHEN lpad(mode_code, 3, '0') BETWEEN '001' AND '009' THEN 'road' WHEN lpad(mode_code, 3, '0') BETWEEN '010' AND '012' THEN 'rail' END AS mode_class,
lpad(mode_code, 3, '0') AS padded, CASE WHEN sex IS NOT NULL THEN CAST(age AS STRING) || '_' || CAST(sex AS STRING) END AS crossed, CASE WHEN age >= 25 THEN edu_code END AS adult_edu, CASE edu_code WHEN '1' THEN 'a' WHEN '2' THEN 'b' END AS mapped, TRY_CAST(nullif(trim(CASE WHEN age % 3 = 0 THEN ' ' || CAST(age AS STRING) || '.5 ' WHEN age % 3 = 1 THEN '  ' ELSE 'x' END), '') AS DOUBLE) AS number,
coalesce(employed_code = '1', false) OR coalesce(school_code = '1', false) AS active, age / 4.0 AS in_wages, CAST(NULL AS BOOLEAN) AS asked, unit AS required,
CASE WHEN prev_local = '3' THEN CASE WHEN nationality IN ('1', '2') THEN 'abroad_citizen' ELSE 'abroad_foreigner' END WHEN prev_local = '2' THEN CASE WHEN birth_local = '1' THEN 'return' WHEN birth_local = '3' THEN 'born_abroad' WHEN prev_unit = '99' THEN 'unknown_origin' WHEN birth_local = '2' AND prev_unit = birth_unit THEN 'first_exit' WHEN birth_local = '2' AND prev_unit <> birth_unit THEN 'multi_stage' ELSE 'other' END END AS status, birth_local,
CASE WHEN coalesce(employed_code = '1', false) THEN work_unit END AS to_work, CASE WHEN NOT coalesce(employed_code = '1', false) THEN work_unit END AS to_study, stratum || '-' || unit AS substitute, CASE WHEN employed_code = '1' THEN 3 WHEN school_code IS NULL THEN 0 ELSE 0 END + CASE WHEN age >= 30 THEN 1 ELSE 0 END AS step, nationality, employed_code, school_code, work_unit FROM persons WHERE edition = '2000'""")
def recodes(s: Survey) -> DataFrame:
    padded = R.pad_code("mode_code", 3)
    text = F.when(F.col("age") % 3 == 0, F.concat(F.lit(" "), F.col("age").cast("string"), F.lit(".5 "))).when(F.col("age") % 3 == 1, F.lit("  ")).otherwise(F.lit("x"))
    names = ["edu_code", "age", "sex", "prev_local", "prev_unit", "unit", "birth_unit", "mode_code", "nationality", "employed_code", "school_code", "work_unit"]
    return s.persons.filter("edition = '2000'").select(
        *names, R.nullify_sentinels("edu_code", ["5"]).alias("known_edu"), R.recode_ranges(padded, [("foot", "007", "007"), ("road", "001", "009"), ("rail", "010", "012")]).alias("mode_class"), padded.alias("padded"),
        R.cross_label(F.col("age").cast("string"), F.col("sex").cast("string")).alias("crossed"), R.in_universe("edu_code", F.col("age") >= 25).alias("adult_edu"), R.map_codes("edu_code", {"1": "a", "2": "b"}).alias("mapped"),
        R.safe_num(text).alias("number"), R.any_yes(["employed_code", "school_code"]).alias("active"), R.to_wage_units("age", 4.0).alias("in_wages"), R.not_measured().alias("asked"), R.require("unit", F.col("unit").isNotNull(), "no unit").alias("required"),
        R.classify_status().alias("status"), "birth_local",
        R.route_destination(F.col("employed_code") == "1", "work_unit").alias("to_work"), R.route_destination(F.col("employed_code") == "1", "work_unit", for_work=False).alias("to_study"), R.substitute_stratum("stratum", "unit").alias("substitute"),
        (F.when(F.col("employed_code") == "1", 3).otherwise(0) + R.classify_breaks("age", [30])).alias("step"),
    ).distinct()


@query(", z AS (SELECT p.*, a.level2 AS now, b.level2 AS old, c.level2 AS born FROM persons p JOIN units a ON a.unit = p.unit LEFT JOIN units b ON b.unit = p.prev_unit LEFT JOIN units c ON c.unit = p.birth_unit) SELECT unit, sum(CASE WHEN is_flow AND old <> now THEN weight ELSE 0 END) AS crossed, sum(CASE WHEN is_flow AND born = now AND old <> now THEN weight ELSE 0 END) AS returned, sum(CASE WHEN age >= 5 AND age % 9 <= 4 AND birth_unit <> unit THEN weight ELSE 0 END) AS proxy FROM z GROUP BY unit")
def crossing_and_return(s: Survey) -> DataFrame:
    up = lambda c, name: s.units.select(F.col("unit").alias(c), F.col("level2").alias(name))
    z = s.persons.join(up("unit", "now"), "unit").join(up("prev_unit", "old"), "prev_unit", "left").join(up("birth_unit", "born"), "birth_unit", "left")
    w = lambda p: F.sum(F.when(p, F.col("weight")).otherwise(0.0))
    return z.groupBy("unit").agg(w(R.flag_cross("is_flow", "old", "now")).alias("crossed"), w(R.flag_return("is_flow", "born", "old", "now")).alias("returned"), w(R.proxy_flow(F.col("age") % 9, "birth_unit", "unit", "age").isNotNull()).alias("proxy"))


_SE = f", u AS ({_UNITS}), si AS (SELECT d AS unit, sqrt(greatest(variance, 0)) AS si FROM ({_variance('d', 'moved')})), so AS (SELECT o AS unit, sqrt(greatest(variance, 0)) AS so FROM ({_variance('o', 'moved')}))"


@query(_SE + ", t AS (SELECT unit, inflow, outflow, (inflow - outflow) / (inflow + outflow) AS v, 2 * sqrt(outflow ** 2 * si ** 2 + inflow ** 2 * so ** 2) / (inflow + outflow) ** 2 AS se, si FROM u JOIN si USING (unit) JOIN so USING (unit)) SELECT unit, round(v, 9) AS effectiveness, round(se, 9) AS se, CASE WHEN abs(v * 12) < 0.15 THEN 'rotation' WHEN abs(v * 12) < 1.96 * se THEN 'undefined' WHEN abs(v * 12) >= 1.0 / 3 THEN 'strong_' || CASE WHEN v > 0 THEN 'gain' ELSE 'loss' END ELSE 'moderate_' || CASE WHEN v > 0 THEN 'gain' ELSE 'loss' END END AS kind, round(greatest(inflow - 1.96 * si, 0), 6) AS low, round(inflow + 1.96 * si, 6) AS high FROM t")
def effectiveness_with_error(s: Survey) -> DataFrame:
    """Classes of twelve times the value: the test's flows are close to balance."""
    moved = s.persons.filter("is_flow")
    side = lambda c, se: estimate.se_cv(estimate.cell_variance(moved.select(F.col(c).alias("u"), "stratum", "psu", "weight"), ["u"], s.frame)).select(F.col("u").alias("unit"), F.col("total").alias(se[-1]), F.col("se").alias(se))
    t = side("unit", "se_i").join(side("prev_unit", "se_o"), "unit")
    v = (F.col("i") - F.col("o")) / (F.col("i") + F.col("o"))
    low, high = R.ci95(F.col("i"), F.col("se_i"))
    t = t.select("unit", v.alias("effectiveness"), R.se_effectiveness("i", "o", "se_i", "se_o").alias("se"), low.alias("low"), high.alias("high"))
    return _rounded(_rounded(t.withColumn("kind", R.classify_effectiveness(F.col("effectiveness") * 12, "se")), 9, "effectiveness", "se"), 6, "low", "high")


@query("SELECT o, d, CASE WHEN total > 2600 AND x THEN 'long_crossing' WHEN total > 2600 THEN 'long_within' WHEN x THEN 'short_crossing' ELSE 'short_within' END AS kind FROM (SELECT o, d, total, a.level2 <> b.level2 AS x FROM flow JOIN units a ON a.unit = o JOIN units b ON b.unit = d)")
def flow_types(s: Survey) -> DataFrame:
    both = flows.attach_ends(s.flow(), s.units, ["level2"])
    far, share = F.when(F.col("total") > 2600, 200.0).otherwise(10.0), F.when(F.col("o_level2") != F.col("d_level2"), 1.0).otherwise(0.0)
    return both.select("o", "d", R.flow_type(far, share).alias("kind"))


@query(f", u AS ({_UNITS}) SELECT unit, inflow + outflow AS turnover, round(1000 * (inflow + outflow) / nullif(pop5, 0), 9) AS turnover_rate FROM u")
def turnover(s: Survey) -> DataFrame:
    return _rounded(measures.turnover(flows.unit_indicators(s.persons, s.units, s.frame)).select("unit", "turnover", "turnover_rate"), 9, "turnover_rate")


@query("SELECT round(sum(CASE WHEN a.level2 <> b.level2 THEN total ELSE 0 END) / sum(total), 9) AS share FROM flow JOIN units a ON a.unit = o JOIN units b ON b.unit = d")
def national_cross(s: Survey) -> DataFrame:
    return _rounded(measures.national_cross(s.flow(), s.units, "level2"), 9, "share")


@query(f", u AS ({_UNITS}) SELECT sum(inflow) AS movers, sum(unknown_origin) AS unknown_origin, sum(international) AS international, sum(pop5) AS pop5, count(*) AS units, (SELECT count(*) FROM flow) AS pairs FROM u")
def national_summary(s: Survey) -> DataFrame:
    return measures.national_summary(flows.unit_indicators(s.persons, s.units, s.frame), s.flow())


@query(_CLASSES + ", r AS (SELECT edition, age_band AS band, sum(CASE WHEN is_flow THEN weight ELSE 0 END) / sum(weight) AS rate FROM c WHERE age_band IS NOT NULL GROUP BY ALL), st AS (SELECT age_band AS band, sum(weight) AS pop FROM c WHERE edition = '2000' AND age_band IS NOT NULL AND age_band <> '60_plus' GROUP BY ALL) SELECT edition, round(100 * sum(rate * pop) / sum(pop), 9) AS smi FROM r JOIN st USING (band) GROUP BY edition")
def standardised_intensity(s: Survey) -> DataFrame:
    c = _classified(s).filter("age_band is not null")
    rates = c.groupBy("edition", F.col("age_band").alias("band")).agg((F.sum(F.when(F.col("is_flow"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("rate"))
    standard = c.filter("edition = '2000' and age_band <> '60_plus'").groupBy(F.col("age_band").alias("band")).agg(F.sum("weight").alias("pop"))
    return _rounded(measures.smi(rates, standard), 9, "smi")


_FIT = f", u AS ({_UNITS}), q AS (SELECT log10(pop / area_km2) AS x, net_rate AS y, pop AS w FROM u JOIN units USING (unit)), a AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM q), b AS (SELECT n, mx, my, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM q, a GROUP BY ALL)"


@query(_FIT + " SELECT b.n AS n, round(max(sxy / sxx), 6) AS slope, round(sqrt(sum(w * (y - my - sxy / sxx * (x - mx)) ** 2) / (b.n - 2) / max(sxx)), 6) AS se FROM q, b GROUP BY b.n")
def fielding_slope(s: Survey) -> DataFrame:
    u = _rounded(flows.unit_indicators(s.persons, s.units, s.frame), 9, "net_rate").join(s.units.select("unit", "area_km2"), "unit")
    return _rounded(measures.fielding_slope(u.withColumn("density", F.col("pop") / F.col("area_km2")), "net_rate", "density", "pop"), 6, "slope", "se")


@query(_FIT + " SELECT n, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 6) AS intercept FROM b")
def weighted_line(s: Survey) -> DataFrame:
    u = _rounded(flows.unit_indicators(s.persons, s.units, s.frame), 9, "net_rate").join(s.units.select("unit", "area_km2"), "unit")
    return _rounded(flows.weighted_slope(u.withColumn("x", F.log10(F.col("pop") / F.col("area_km2"))), "x", "net_rate", "pop"), 6, "slope", "intercept")


@query(_CLASSES + ", g AS (SELECT unit, sum(CASE WHEN is_flow AND education = 'high' THEN weight ELSE 0 END) AS a, sum(CASE WHEN is_flow AND education = 'low' THEN weight ELSE 0 END) AS b, sum(CASE WHEN NOT is_flow AND education = 'high' THEN weight ELSE 0 END) AS c, sum(CASE WHEN NOT is_flow AND education = 'low' THEN weight ELSE 0 END) AS d FROM c WHERE age >= 25 GROUP BY unit) SELECT unit, round(a * d / nullif(b * c, 0), 9) AS odds_ratio FROM g")
def selectivity(s: Survey) -> DataFrame:
    trait = F.when(F.col("education") == "high", True).when(F.col("education") == "low", False)
    return _rounded(measures.selectivity_or(_classified(s).filter("age >= 25"), trait, F.col("is_flow"), ["unit"]), 9, "odds_ratio")


_BANDS = [("05_14", 5, 15), ("15_24", 15, 25), ("25_39", 25, 40), ("40_59", 40, 60), ("60_plus", 60, 90)]


@query(_CLASSES + ", sx AS (SELECT unit, 100 * sum(CASE WHEN sex = 1 THEN weight END) / sum(CASE WHEN sex = 2 THEN weight END) AS sex_ratio FROM c GROUP BY unit), bd AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {a}.0, {b}.0)" for i, (n, a, b) in enumerate(_BANDS)) + ") t(age_band, i, low, high)), g AS (SELECT unit, age_band, i, low, high, sum(weight) AS m FROM c JOIN bd USING (age_band) GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY unit ORDER BY i) AS run, sum(m) OVER (PARTITION BY unit) AS whole FROM g) SELECT unit, round(sex_ratio, 9) AS sex_ratio, round(median_age, 9) AS median_age, peak_band FROM sx JOIN (SELECT unit, max(CASE WHEN run >= 0.5 * whole AND run - m < 0.5 * whole THEN low + (high - low) * (0.5 * whole - (run - m)) / m END) AS median_age FROM r GROUP BY unit) USING (unit) JOIN (SELECT unit, age_band AS peak_band FROM g QUALIFY row_number() OVER (PARTITION BY unit ORDER BY m DESC, i) = 1) USING (unit)")
def age_sex_summary(s: Survey) -> DataFrame:
    return _rounded(measures.age_sex_summary(_classified(s), _BANDS, ["unit"]), 9, "sex_ratio", "median_age")


@query(_CLASSES + ", g AS (SELECT unit, lower(age_band) || CASE WHEN sex = 1 THEN '_m' WHEN sex = 2 THEN '_f' ELSE '_i' END AS k, sum(weight) AS t FROM c WHERE age_band IS NOT NULL GROUP BY ALL), w AS (SELECT unit, sum(t) AS whole, coalesce(sum(CASE WHEN k LIKE '%\\_i' ESCAPE '\\' THEN t END), 0) AS oth FROM g GROUP BY unit), b AS (SELECT unnest(['05_14', '15_24', '25_39', '40_59', '60_plus']) AS band) SELECT w.unit, band, coalesce(m.t, 0) AS men, coalesce(f.t, 0) AS women, round(100 * coalesce(m.t, 0) / whole, 9) AS pct_men, round(100 * coalesce(f.t, 0) / whole, 9) AS pct_women, round(100 * oth / whole, 9) AS pct_other FROM w CROSS JOIN b LEFT JOIN g m ON m.unit = w.unit AND m.k = band || '_m' LEFT JOIN g f ON f.unit = w.unit AND f.k = band || '_f'")
def pyramid(s: Survey) -> DataFrame:
    suffix = F.when(F.col("sex") == 1, "_M").when(F.col("sex") == 2, "_F").otherwise("_I")
    rows = _classified(s).filter("age_band is not null").select("unit", F.concat("age_band", suffix).alias("category"), F.col("weight").alias("total"))
    return _rounded(measures.pyramid(rows, ["unit"], [b for b, _, _ in _BANDS]), 9, "pct_men", "pct_women", "pct_other")


@query(_CLASSES + " SELECT unit, income AS category, sum(weight) AS total, round(100 * sum(weight) / sum(sum(weight)) OVER (PARTITION BY unit), 9) AS share FROM c GROUP BY unit, income")
def composition(s: Survey) -> DataFrame:
    rows = _classified(s).groupBy("unit", F.col("income").alias("category")).agg(F.sum("weight").alias("total"))
    return _rounded(estimate.composition(rows, ["unit"]), 9, "share")


@query(_CLASSES + " SELECT unit, CASE WHEN income IN ('i1', 'i2') THEN 'low' WHEN income IN ('i4', 'i5') THEN 'high' ELSE 'rest' END AS category, sum(weight) AS total FROM c GROUP BY ALL")
def regrouped_income(s: Survey) -> DataFrame:
    rows = _classified(s).groupBy("unit", F.col("income").alias("category")).agg(F.sum("weight").alias("total"))
    return measures.regroup(rows, ["unit"], {"low": ["i1", "i2"], "high": ["i4", "i5"]}, "rest")


@query(_CLASSES + ", i AS (SELECT unit, sum(weight) AS t FROM c WHERE is_flow AND income = 'i1' GROUP BY unit HAVING count(*) >= 150), o AS (SELECT prev_unit AS unit, sum(weight) AS t FROM c WHERE is_flow AND income = 'i1' GROUP BY prev_unit HAVING count(*) >= 150) SELECT unit, i.t AS inflow, o.t AS outflow, i.t - o.t AS balance FROM i FULL JOIN o USING (unit)")
def subgroup_balance(s: Survey) -> DataFrame:
    side = lambda c, way: estimate.long_profile(_classified(s).filter("is_flow").select(F.col(c).alias("unit"), "psu", "weight", "income"), ["unit"], ["income"]).withColumn("direction", F.lit(way))
    return measures.subgroup_balance(side("unit", "in").unionByName(side("prev_unit", "out")).filter("n >= 150"), "income", "i1")


@query(f" SELECT level2 AS o, round(sqrt(sum(greatest(variance, 0))), 6) AS se FROM ({_variance('o, d', 'moved')}) v JOIN units u ON u.unit = v.o GROUP BY level2")
def combined_errors(s: Survey) -> DataFrame:
    m = flows.attach_ends(flows.flow_matrix(s.persons, s.frame), s.units, ["level2"])
    return _rounded(measures.combine_se(m.select(F.col("o_level2").alias("o"), "se"), ["o"]), 6, "se")


@query(f", v AS (SELECT total, 100 * sqrt(greatest(variance, 0)) / total AS cv FROM ({_variance('o, d', 'moved')})) SELECT CASE WHEN total >= 2500 THEN 2500.0::DOUBLE WHEN total >= 1500 THEN 1500.0::DOUBLE ELSE 0.0::DOUBLE END AS size, count(*) AS cells, round(median(cv / (100 * 2.5 * pow(total, -0.5))), 6) AS ratio FROM v GROUP BY 1")
def gvf_ratios(s: Survey) -> DataFrame:
    return _rounded(measures.gvf_ratio(flows.flow_matrix(s.persons, s.frame), 2.5, -0.5, [0, 1500, 2500]), 6, "ratio")


@query("SELECT unit AS code, CASE WHEN unit < '10' THEN unit_name ELSE 'old ' || unit END AS name, unit < '20' AS in_force FROM units")
def latest_names(s: Survey) -> DataFrame:
    u = s.units
    now = u.select(F.col("unit").alias("code"), F.when(F.col("unit") < "10", F.col("unit_name")).otherwise("").alias("name"), F.lit(0).alias("priority"), (F.col("unit") < "20").alias("current"))
    old = u.select(F.col("unit").alias("code"), F.concat(F.lit("old "), "unit").alias("name"), F.lit(1).alias("priority"), F.lit(False).alias("current"))
    return measures.latest_name(now.unionByName(old))


_EF = ", ef AS (SELECT edition, o, d, sum(weight) AS total FROM moved GROUP BY ALL), iu AS (SELECT edition, d AS unit, sum(total) AS v FROM ef GROUP BY ALL), rk AS (SELECT edition, unit, v, rank() OVER (PARTITION BY edition ORDER BY v DESC) AS place FROM iu)"


def _inflow(s: Survey) -> DataFrame:
    return s.edition_flow().groupBy("edition", F.col("d").alias("unit")).agg(F.sum("total").alias("v"))


@query(_EF + ", w AS (SELECT unit, max(CASE WHEN edition = '1999' THEN place END) AS a, max(CASE WHEN edition = '2000' AND place <= 10 THEN place END) AS b FROM rk GROUP BY unit) SELECT unit, row_number() OVER (ORDER BY b NULLS LAST, a NULLS LAST, unit) AS position FROM w")
def order_by_recent_rank(s: Survey) -> DataFrame:
    ranks = flows.partner_rank(_inflow(s).withColumnRenamed("v", "total"), "edition").filter("edition = '1999' or (edition = '2000' and place <= 10)")
    return measures.order_by_recent_rank(ranks.unionByName(_inflow(s).select("edition", "unit", F.col("v").alias("total"), F.lit(None).cast("int").alias("place")).filter("edition < '1999'")), ["1999", "2000"])


@query(_EF + ", tp AS (SELECT edition, o AS unit, d AS partner, row_number() OVER (PARTITION BY edition, o ORDER BY total DESC, d) AS place FROM ef QUALIFY place <= 10) SELECT a.unit, count(b.partner) / 10.0::DOUBLE AS overlap FROM (SELECT * FROM tp WHERE edition = '1999') a LEFT JOIN (SELECT * FROM tp WHERE edition = '2000') b ON b.unit = a.unit AND b.partner = a.partner GROUP BY a.unit")
def top_overlap(s: Survey) -> DataFrame:
    top = lambda e: flows.top_partners(s.edition_flow().filter(F.col("edition") == e).select("o", "d", "total"), 10).filter("direction = 'out'")
    return series.top_overlap(top("1999"), top("2000"), 10)


@query(f", {_E}, u AS (SELECT unit, CAST(sum(inflow) AS DOUBLE) AS v FROM ends GROUP BY unit), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, unit) AS a, row_number() OVER (ORDER BY v, unit) AS b FROM u) SELECT unit, v, 'top' AS side FROM r WHERE a <= 3 UNION ALL SELECT unit, v, 'bottom' FROM r WHERE b <= 3")
def extremes(s: Survey) -> DataFrame:
    return measures.extremes(flows.level_indicators(s.flow()).select("unit", F.col("inflow").alias("v")), "v", 3)


@query(f", u AS ({_UNITS}) SELECT unit, net_rate FROM u WHERE pop >= 60000 ORDER BY net_rate DESC, unit LIMIT 5")
def ranked_units(s: Survey) -> DataFrame:
    return measures.ranked(_rounded(flows.unit_indicators(s.persons, s.units, s.frame), 9, "net_rate"), "net_rate", "pop", 60000, 5).select("unit", "net_rate")


@query(_METRO + ", t AS (SELECT prev_unit AS o, unit AS d, coalesce(CASE WHEN commutes THEN work_unit END, 'none') AS work, class, sum(weight) AS total FROM mv WHERE employed GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o, d, work) AS p FROM t), q AS (SELECT CASE WHEN p <= 12 THEN o ELSE 'other' END AS o, CASE WHEN p <= 12 THEN d ELSE 'other' END AS d, CASE WHEN p <= 12 THEN work ELSE 'other' END AS work, CASE WHEN p <= 12 THEN class ELSE 'other' END AS class, total FROM r) SELECT 0 AS stage, o AS source, d AS target, 'residence' AS class, sum(total) AS total FROM q GROUP BY ALL UNION ALL SELECT 1, d, work, class, sum(total) FROM q GROUP BY ALL")
def alluvial(s: Survey) -> DataFrame:
    from odflow.operators import metro

    paths = metro.move_commute_triples(_movers(s)).groupBy("o", "d", F.coalesce("work", F.lit("none")).alias("work"), "class").agg(F.sum("total").alias("total"))
    return measures.alluvial(paths, ["o", "d", "work"], 12)


@query(f", {_E}, u AS (SELECT unit, abs(CAST(sum(inflow) - sum(outflow) AS DOUBLE)) AS v FROM ends GROUP BY unit), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM u WHERE v > 0) SELECT max(CASE WHEN i = floor(0.6 * n) THEN v END) AS b1, max(CASE WHEN i = floor(0.85 * n) THEN v END) AS b2, max(CASE WHEN i = least(n - 1, floor(0.96 * n)) THEN v END) AS b3 FROM r")
def symmetric_breaks(s: Survey) -> DataFrame:
    return measures.symmetric_breaks(flows.level_indicators(s.flow()), "net")


@query(", r AS (SELECT total, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM flow) SELECT o, d, total FROM flow WHERE total >= (SELECT total FROM r WHERE i = floor(0.9 * (n - 1)))")
def quantile_filter(s: Survey) -> DataFrame:
    return measures.quantile_filter(s.flow().select("o", "d", "total"), "total", 0.9)


@query("SELECT unit, median(commute_min) AS median_all, median(CASE WHEN employed_code = '1' THEN commute_min END) AS median_employed FROM persons GROUP BY unit")
def medians(s: Survey) -> DataFrame:
    return s.persons.groupBy("unit").agg(measures.median_of("commute_min").alias("median_all"), measures.median_of("commute_min", F.col("employed_code") == "1").alias("median_employed"))


@query(", e AS (SELECT psu, count(CASE WHEN age >= 18 THEN 1 END) AS k FROM persons GROUP BY psu), h AS (SELECT o_orderkey AS psu, o_totalprice AS income FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') SELECT unit, count(income) AS with_household, round(sum(income / nullif(k, 0)), 3) AS per_capita FROM persons LEFT JOIN h USING (psu) LEFT JOIN e USING (psu) GROUP BY unit")
def per_capita_income(s: Survey) -> DataFrame:
    h = read(s.spark, s.sf_dir, "orders").filter("o_orderpriority <> '4-NOT SPECIFIED'").select(F.col("o_orderkey").alias("psu"), F.col("o_totalprice").alias("income"))
    people = measures.attach_household(measures.per_capita(s.persons, h, "income", F.col("age") >= 18), h)
    return _rounded(people.groupBy("unit").agg(F.count("income").alias("with_household"), F.sum("per_capita").alias("per_capita")), 3, "per_capita")


@query("SELECT u.unit, coalesce(i, 0) AS big_in, coalesce(x, 0) AS big_out FROM units u LEFT JOIN (SELECT d AS unit, sum(total) AS i FROM flow WHERE total > 3000 GROUP BY d) USING (unit) LEFT JOIN (SELECT o AS unit, sum(total) AS x FROM flow WHERE total > 3000 GROUP BY o) USING (unit)")
def spine(s: Survey) -> DataFrame:
    big = s.flow().filter("total > 3000")
    parts = [big.groupBy(F.col("d").alias("unit")).agg(F.sum("total").alias("big_in")), big.groupBy(F.col("o").alias("unit")).agg(F.sum("total").alias("big_out"))]
    return measures.spine_join(s.units.select("unit"), parts)


@query("SELECT name, sum(weight) AS total FROM (SELECT weight, CASE WHEN prev_local = '2' AND prev_unit BETWEEN '00' AND '24' THEN (SELECT any_value(unit_name) FROM units u WHERE u.unit = p.prev_unit) END AS name FROM persons p) GROUP BY name")
def conditional_lookup(s: Survey) -> DataFrame:
    names = s.units.select(F.col("unit").alias("code"), F.col("unit_name").alias("value"))
    guard = (F.col("prev_local") == "2") & F.col("prev_unit").between("00", "24")
    return measures.conditional_lookup(s.persons, names, F.concat(F.substring("prev_unit", 1, 1), F.substring("prev_unit", 2, 1)), guard, name="name").groupBy("name").agg(F.sum("weight").alias("total"))


@query(", z AS (SELECT a.unit AS point, b.unit AS target, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS k FROM units a CROSS JOIN units b WHERE b.metro IS NULL) SELECT point, target, round(k, 9) AS distance FROM z QUALIFY row_number() OVER (PARTITION BY point ORDER BY k, target) = 1")
def nearest_units(s: Survey) -> DataFrame:
    points = s.units.select(F.col("unit").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    targets = s.units.filter("metro is null").select(F.col("unit").alias("target"), F.col("lon").alias("tx"), F.col("lat").alias("ty"))
    return _rounded(measures.nearest(points, targets), 9, "distance")


@query("SELECT unit AS code, 'unexpected' AS side FROM units WHERE unit NOT IN (SELECT CAST(unit AS STRING) FROM persons WHERE unit < '20') UNION ALL SELECT DISTINCT 'x' || unit, 'missing' FROM persons WHERE unit = '03'")
def code_differences(s: Survey) -> DataFrame:
    known = s.persons.filter("unit < '20'").select(F.col("unit").alias("code")).unionByName(s.persons.filter("unit = '03'").select(F.concat(F.lit("x"), "unit").alias("code")))
    return audit.code_diff(s.units.select(F.col("unit").alias("code")), known)


@query(", a AS (SELECT * FROM persons WHERE edition = '2000'), b AS (SELECT * FROM persons WHERE edition = '2000' AND age <> 7) SELECT 'rows' AS check, CAST((SELECT count(*) FROM a) AS DOUBLE) AS left, CAST((SELECT count(*) FROM b) AS DOUBLE) AS right, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS ok UNION ALL SELECT 'weight', (SELECT sum(weight) FROM a), (SELECT sum(weight) FROM b), false UNION ALL SELECT 'ages', (SELECT count(*) FROM a WHERE age = 7), 0, false")
def reconciled_sources(s: Survey) -> DataFrame:
    a = s.persons.filter("edition = '2000'")
    return audit.reconcile(a, a.filter("age <> 7"), {"ages": ["unit", "age", "sex"]})


@query(", ck AS (SELECT unit, printf('%06d', CAST(unit AS INT) * 4099 + 11) AS c FROM units), dg AS (SELECT unit, c, (10 - (CAST(c[1] AS INT) + CAST(c[3] AS INT) + CAST(c[5] AS INT) + list_sum(list_transform([CAST(c[2] AS INT) * 2, CAST(c[4] AS INT) * 2, CAST(c[6] AS INT) * 2], lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END))) % 10) % 10 AS k FROM ck) SELECT count(*) AS codes, count(CASE WHEN k <> CAST(unit AS INT) % 10 THEN 1 END) AS invalid FROM dg")
def check_digits(s: Survey) -> DataFrame:
    k = F.col("unit").cast("int")
    return audit.code_check_digit(s.units.select(F.concat(F.lpad((k * 4099 + 11).cast("string"), 6, "0"), (k % 10).cast("string")).alias("code")), "code")


@query("SELECT CASE WHEN o = '15' THEN '01' WHEN o >= '20' THEN lpad(CAST(CAST(o AS INT) - 20 AS STRING), 2, '0') ELSE o END AS o, CASE WHEN d = '15' THEN '01' WHEN d >= '20' THEN lpad(CAST(CAST(d AS INT) - 20 AS STRING), 2, '0') ELSE d END AS d, sum(total) AS total FROM flow GROUP BY ALL")
def successor_codes(s: Survey) -> DataFrame:
    mapping = s.units.filter("unit >= '20' or unit = '15'").select(F.col("unit").alias("old"), F.when(F.col("unit") == "15", "01").otherwise(F.lpad((F.col("unit").cast("int") - 20).cast("string"), 2, "0")).alias("new"))
    return series.recode_successor(s.flow().select("o", "d", "total"), ["o", "d"], mapping).groupBy("o", "d").agg(F.sum("total").alias("total"))

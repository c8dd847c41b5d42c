"""Queries on disclosure control, audits and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators import audit, estimate, flows, linked, metro, release
from odflow.plans.metro_queries import _BASE, _METRO, _movers, _people
from odflow.plans.queries import _CLASSES, _E, _LONG, _UNITS, Survey, _classified, _rounded, _variance, query
from odflow.plans.views import read
from odflow.sources import files, store
from odflow.spec import Limits

_WIDE = {"education": ["low", "high"], "age_band": ["15_24", "25_39"], "income": ["i1", "i5"]}
_UNI = {"education": "age >= 25"}
_BAND = "CASE WHEN {0} < 5 THEN '<5' WHEN {0} < 20 THEN '5-19' WHEN {0} < 50 THEN '20-49' WHEN {0} < 100 THEN '50-99' WHEN {0} < 500 THEN '100-499' ELSE '500+' END"
_PRECISION = "CASE WHEN cv IS NULL THEN 'none' WHEN cv <= 15 THEN 'good' WHEN cv <= 30 THEN 'caution' ELSE 'low' END"


def _wide_sql() -> str:
    out = []
    for d, cs in _WIDE.items():
        u = _UNI.get(d, "TRUE")
        n = lambda c: f"count(CASE WHEN {u} AND {d} = '{c}' THEN 1 END)"  # noqa: B023,E731
        w = lambda c: f"coalesce(sum(CASE WHEN {u} AND {d} = '{c}' THEN weight END), 0)"  # noqa: B023,E731
        out += [f"CASE WHEN {n(c)} >= 5 THEN {w(c)} END AS {d}__{c}" for c in cs]
        rest = f"coalesce(sum(CASE WHEN {u} AND {d} NOT IN ({', '.join(repr(c) for c in cs)}) THEN weight END), 0)"
        out.append(" + ".join([rest, *(f"CASE WHEN {n(c)} >= 5 THEN 0 ELSE {w(c)} END" for c in cs)]) + f" AS {d}__other")
    return ", ".join(out)


_CELLS = _CLASSES + f", cells AS (SELECT prev_unit AS o, unit AS d, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu, {_wide_sql()} FROM c WHERE is_flow AND edition >= '1999' GROUP BY prev_unit, unit)"


def _moved(s: Survey) -> DataFrame:
    return _classified(s).filter("is_flow and edition >= '1999'").withColumnsRenamed({"prev_unit": "o", "unit": "d"})


def _cells(s: Survey) -> DataFrame:
    return release.suppress_wide(_moved(s), ["o", "d"], _WIDE, {"education": F.col("age") >= 25})


@query(_CELLS + " SELECT * FROM cells")
def suppressed_wide(s: Survey) -> DataFrame:
    return _cells(s)


_DETAIL = [f"{d}__{c}" for d, cs in _WIDE.items() for c in [*cs, "other"]]


@query(_CELLS + f", v AS ({_variance('o, d', 'moved')}) SELECT o, d, round(cells.total / 5.0) * 5 AS total, round(sqrt(greatest(variance, 0)), 6) AS se, round(100 * sqrt(greatest(variance, 0)) / v.total, 6) AS cv, {_BAND.format('cells.n')} AS n_band, {_PRECISION.replace('cv', '(100 * sqrt(greatest(variance, 0)) / v.total)')} AS precision, cells.n >= 20 AS has_detail, "
       + ", ".join(f"CASE WHEN cells.n >= 20 THEN round({c} / 5.0) * 5 END AS {c}" for c in _DETAIL) + " FROM cells JOIN v USING (o, d) WHERE cells.n >= 5 AND cells.n_psu >= 3")
def published_profiled_flows(s: Survey) -> DataFrame:
    return _rounded(release.publish_profiled_flows(_cells(s), flows.flow_matrix(s.persons, s.frame), digits=False), 6, "se", "cv")


_FIVES = ", ".join(f"round({c} / 5.0) * 5 AS {c}" for c in ("pop", "pop5", "inflow", "unknown_origin", "international", "outflow", "net"))
_ROUNDS = ", ".join(f"round({c}, {d}) AS {c}" for c, d in (("in_rate", 2), ("out_rate", 2), ("net_rate", 2), ("effectiveness", 4), ("se_in", 1), ("se_out", 1), ("se_net", 1), ("cv_in", 2), ("cv_out", 2)))


@query(f"SELECT unit, {_FIVES}, {_ROUNDS}, {_BAND.format('n_in')} AS in_band, {_BAND.format('n_out')} AS out_band, {_PRECISION.replace('cv ', 'cv_in ')} AS precision_in, {_PRECISION.replace('cv ', 'cv_out ')} AS precision_out FROM ({_UNITS})")
def published_units(s: Survey) -> DataFrame:
    units = flows.unit_indicators(s.persons, s.units, s.frame)
    return release.publish_units(_rounded(_rounded(units, 9, "in_rate", "out_rate", "net_rate", "effectiveness"), 6, "se_in", "se_out", "se_net", "cv_in", "cv_out"))


@query(_LONG + f", k AS (SELECT unit, dimension, category, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS m FROM l WHERE category IS NOT NULL GROUP BY ALL), f AS (SELECT unit, dimension, CASE WHEN n >= 5 AND m >= 3 THEN category ELSE 'other' END AS category, sum(total) AS total, sum(n) AS n FROM k GROUP BY ALL) SELECT unit, dimension, category, round(total / 5.0) * 5 AS total, {_BAND.format('n')} AS n_band FROM f")
def published_unit_profile(s: Survey) -> DataFrame:
    profile = estimate.long_profile(_classified(s), ["unit"], ["age_band", "education", "income"], {"education": F.col("age") >= 25})
    return release.publish_profile(profile, ["unit"], nulls="drop")


@query(_BASE + f", l AS (SELECT o, d, psu, weight, 'mode_code' AS dimension, mode_code AS category FROM wc UNION ALL SELECT o, d, psu, weight, 'age_band', coalesce(age_band, 'unknown') FROM wc), p AS (SELECT o, d FROM wc GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT psu) >= 3), k AS (SELECT o, d, dimension, category, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS m FROM l JOIN p USING (o, d) GROUP BY ALL), f AS (SELECT o, d, dimension, CASE WHEN n >= 5 AND m >= 3 THEN category ELSE 'other' END AS category, sum(total) AS total, sum(n) AS n FROM k GROUP BY ALL) SELECT o, d, dimension, category, round(total / 5.0) * 5 AS total, {_BAND.format('n')} AS n_band FROM f")
def published_commute_profile(s: Survey) -> DataFrame:
    people = _people(s)
    return release.publish_profile(metro.commute_profile(people, ["mode_code", "age_band"]), ["o", "d"], pairs=metro.commute_matrix(people, s.frame))


@query(_BASE + f", v AS (SELECT *, 100 * sqrt(greatest(variance, 0)) / total AS cv FROM ({_variance('o, d', 'wc')})) SELECT o, d, round(total / 5.0) * 5 AS total, round(sqrt(greatest(variance, 0)), 6) AS se, round(cv, 6) AS cv, {_BAND.format('n')} AS n_band, {_PRECISION} AS precision, minutes FROM v JOIN (SELECT o, d, median(commute_min) AS minutes FROM wc GROUP BY ALL) USING (o, d) WHERE n >= 5 AND n_psu >= 3")
def published_commute_flows(s: Survey) -> DataFrame:
    return _rounded(release.publish_cells(metro.commute_matrix(_people(s), s.frame), ["o", "d"], extra=["minutes"], digits=False), 6, "se", "cv")


@query(f", lm AS (SELECT a.level1 AS o, b.level1 AS d, stratum, psu, weight FROM moved JOIN units a ON a.unit = o JOIN units b ON b.unit = d WHERE a.level1 <> b.level1), v AS (SELECT *, 100 * sqrt(greatest(variance, 0)) / total AS cv FROM ({_variance('o, d', 'lm')})) SELECT o, d, round(total / 5.0) * 5 AS total, round(sqrt(greatest(variance, 0)), 6) AS se, round(cv, 6) AS cv, {_BAND.format('n')} AS n_band, {_PRECISION} AS precision FROM v WHERE n >= 5 AND n_psu >= 3")
def published_level_flows(s: Survey) -> DataFrame:
    return _rounded(release.publish_cells(flows.rollup_flows(s.persons, s.units, "level1", s.frame), ["o", "d"], digits=False), 6, "se", "cv")


@query(_METRO + f", t AS (SELECT metro, prev_unit AS o, unit AS d, CASE WHEN commutes THEN work_unit END AS work, class, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS m FROM mv WHERE employed GROUP BY ALL) SELECT metro, o, d, work, class, round(total / 5.0) * 5 AS total, {_BAND.format('n')} AS n_band FROM t WHERE n >= 5 AND m >= 3")
def published_triples(s: Survey) -> DataFrame:
    return release.publish_cells(metro.move_commute_triples(_movers(s)), ["metro", "o", "d", "work", "class"])


_NAMES = [f"{d}__{c}" for d, cs in _WIDE.items() for c in cs]


@query(_CELLS + ", t AS (SELECT prev_unit AS o, unit AS d, " + ", ".join(f"count(CASE WHEN {_UNI.get(d, 'TRUE')} AND {d} = '{c}' THEN 1 END) AS n_{d}__{c}" for d, cs in _WIDE.items() for c in cs) + " FROM c WHERE is_flow AND edition = '2000' GROUP BY ALL), j AS (SELECT * FROM cells LEFT JOIN t USING (o, d)) "
       + " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS shown, count(CASE WHEN {c} IS NOT NULL AND coalesce(n_{c}, 0) < 5 THEN 1 END) AS below FROM j" for c in _NAMES))
def audit_of_category_cells(s: Survey) -> DataFrame:
    """The cells of all editions from 1999 on, set against the persons of 2000 alone, so that some fail."""
    micro = _moved(s).filter("edition = '2000'")
    return audit.audit_cells(_cells(s), micro, ["o", "d"], _WIDE, {"education": F.col("age") >= 25})


@query(_CELLS + ", t AS (SELECT prev_unit AS o, unit AS d, count(*) AS k FROM c WHERE is_flow AND edition = '2000' GROUP BY ALL) SELECT count(*) AS shown, count(CASE WHEN coalesce(k, 0) < 20 THEN 1 END) AS below FROM cells LEFT JOIN t USING (o, d) WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in _NAMES))
def audit_of_detail(s: Survey) -> DataFrame:
    return audit.audit_detail(_cells(s), _moved(s).filter("edition = '2000'"), ["o", "d"], _NAMES)


@query("SELECT count(psu) AS with_psu, count(psu) > 0 AS ok FROM persons")
def audit_of_declared_households(s: Survey) -> DataFrame:
    return audit.audit_psu_declared(s.persons, True)


_EDGES = "SELECT o, d, edition, sum(weight) AS total, count(*) AS n, count(DISTINCT psu) AS n_psu FROM moved GROUP BY ALL"


def _edition_cells(s: Survey) -> DataFrame:
    rows = s.persons.filter("is_flow").select(F.col("prev_unit").alias("o"), F.col("unit").alias("d"), "edition", "psu", "weight")
    return estimate.cell_estimate(rows, ["o", "d", "edition"])


@query(f", e AS ({_EDGES}) SELECT k, count(*) AS cells, count(CASE WHEN n_psu < 3 THEN 1 END) AS rejected, round(count(CASE WHEN n_psu < 3 THEN 1 END) / count(*), 9) AS share FROM e JOIN (SELECT unnest([3, 5, 8, 10, 20]) AS k) ON n >= k GROUP BY k")
def calibrated_thresholds(s: Survey) -> DataFrame:
    return _rounded(audit.calibrate_threshold(_edition_cells(s), [3, 5, 8, 10, 20]), 9, "share")


@query(f", e AS (SELECT o, edition, d AS category, total, n, n_psu, CASE WHEN n >= 5 AND n_psu >= 3 THEN 1 ELSE 0 END AS good FROM ({_EDGES})), k AS (SELECT *, sum(1 - good) OVER (PARTITION BY o, edition) AS failed, row_number() OVER (PARTITION BY o, edition ORDER BY good DESC, total, category) AS p FROM e) SELECT o, edition, category, total, n, n_psu, good = 1 AND NOT (failed = 1 AND p = 1) AS kept FROM k")
def complementary_suppression(s: Survey) -> DataFrame:
    return release.complementary(_edition_cells(s).withColumnRenamed("d", "category"), ["o", "edition"])


@query(f", e AS (SELECT *, n >= 5 AND n_psu >= 3 AS kept FROM ({_EDGES})) SELECT o, edition, count(*) AS cells FROM e GROUP BY ALL HAVING count(CASE WHEN NOT kept THEN 1 END) = 1 AND count(*) > 1")
def audit_of_differencing(s: Survey) -> DataFrame:
    return release.audit_differencing(_edition_cells(s).withColumn("kept", release.passes(Limits())), ["o", "edition"])


@query(f", e AS ({_EDGES}), p AS (SELECT o, d FROM e WHERE edition = '2000' AND n >= 5 AND n_psu >= 3) SELECT count(*) AS pairs, count(p.o) AS published, round(100 * sum(CASE WHEN p.o IS NOT NULL THEN total END) / sum(total), 9) AS pct_volume FROM (SELECT * FROM e WHERE edition = '2000') f LEFT JOIN p ON p.o = f.o AND p.d = f.d")
def suppression_report(s: Survey) -> DataFrame:
    cells = _edition_cells(s).filter("edition = '2000'")
    return _rounded(release.suppression_report(cells, release.suppress_rows(cells)), 9, "pct_volume")


@query(f", e AS (SELECT round(total / 5.0) * 5 AS total, {_BAND.format('n')} AS n_band FROM ({_EDGES})) SELECT CAST(0 AS BIGINT) AS banned_columns, count(CASE WHEN total % 5 <> 0 THEN 1 END) AS off_base, count(CASE WHEN n_band IN ('<5', '5-19') THEN 1 END) AS bad_bands FROM e")
def audit_of_structure(s: Survey) -> DataFrame:
    from odflow.functions.recode import band_n, bands_below, round_base

    table = _edition_cells(s).select(round_base("total").alias("total"), band_n("n").alias("n_band"))
    return audit.audit_structure(table, bands_forbidden=bands_below(Limits.of(False).persons))


@query("SELECT 'o' AS column, count(CASE WHEN o IN ('03', '07') THEN 1 END) AS hits FROM flow UNION ALL SELECT 'd', count(CASE WHEN d IN ('03', '07') THEN 1 END) FROM flow")
def leaked_codes(s: Survey) -> DataFrame:
    return audit.scan_codes(s.flow(), ["03", "07"])


_IDS = f"u AS ({_UNITS}), f AS (SELECT sum(total) AS t FROM flow), x AS (SELECT sum(inflow) AS i, sum(outflow) AS o, sum(net) AS net FROM u)"


@query(f", {_IDS} SELECT 'in_out' AS name, i AS value, o AS expected, abs(i - o) < 1e-6 AS ok FROM x UNION ALL SELECT 'in_flows', i, t, abs(i - t) < 1e-6 FROM x, f UNION ALL SELECT 'net', net, 0, abs(net) < 1e-6 FROM x")
def check_identities(s: Survey) -> DataFrame:
    return audit.check_identities(flows.unit_indicators(s.persons, s.units, s.frame), s.flow())


@query("SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS value, CAST(1000 AS DOUBLE) AS expected, count(*) >= 1000 AS ok FROM persons UNION ALL SELECT 'weight', sum(weight), 150000, abs(sum(weight) - 150000) < 100 FROM persons UNION ALL SELECT 'groups', count(DISTINCT unit), 25, count(DISTINCT unit) = 25 FROM persons")
def check_totals(s: Survey) -> DataFrame:
    return audit.check_totals(s.persons, 1000, 150000.0, 25, "unit")


@query("SELECT unit, coalesce(w, 0) AS value, area_km2 * 200 AS expected, coalesce(w, 0) BETWEEN 0.7 * (area_km2 * 200) AND 1.3 * (area_km2 * 200) AS ok FROM units LEFT JOIN (SELECT unit, sum(weight) AS w FROM persons GROUP BY unit) USING (unit)")
def check_group_totals(s: Survey) -> DataFrame:
    return audit.check_group_totals(s.persons, s.units.select("unit", (F.col("area_km2") * 200).alias("expected")), "unit")


@query("SELECT 'moved' AS name, round(100 * count(CASE WHEN is_flow THEN 1 END) / count(*), 9) AS value, CAST(90 AS DOUBLE) AS expected, 100 * count(CASE WHEN is_flow THEN 1 END) / count(*) BETWEEN 2 AND 90 AS ok FROM persons")
def check_share(s: Survey) -> DataFrame:
    return _rounded(audit.check_share(s.persons, F.col("is_flow"), 2, 90, "moved"), 9, "value")


@query("SELECT 'join' AS name, CAST(count(o_orderkey) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS expected, count(o_orderkey) = count(*) AS ok FROM persons LEFT JOIN orders ON o_orderkey = psu")
def check_join_complete(s: Survey) -> DataFrame:
    households = read(s.spark, s.sf_dir, "orders").select(F.col("o_orderkey").alias("psu"))
    return audit.check_join_complete(s.persons, households, "psu")


@query(_BASE + " SELECT 'is_flow' AS name, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS expected, true AS ok UNION ALL SELECT 'employed', 0, 0, true UNION ALL SELECT 'sex', count(*) - count(sex), 0, count(*) = count(sex) FROM pc UNION ALL SELECT 'loops', count(CASE WHEN o = d THEN 1 END), 0, count(CASE WHEN o = d THEN 1 END) = 0 FROM flow")
def check_flags_and_loops(s: Survey) -> DataFrame:
    return audit.check_flags(_people(s), ["is_flow", "employed", "sex"]).unionByName(audit.check_loops(s.flow()))


@query(f", {_E}, u AS (SELECT unit, CAST((sum(inflow) - sum(outflow)) / (sum(inflow) + sum(outflow)) AS DOUBLE) AS v FROM ends GROUP BY unit) SELECT 'effectiveness' AS name, CAST(count(CASE WHEN v NOT BETWEEN -1e-9 AND 0.02 + 1e-9 THEN 1 END) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS expected, count(CASE WHEN v NOT BETWEEN -1e-9 AND 0.02 + 1e-9 THEN 1 END) = 0 AS ok FROM u")
def check_bounds(s: Survey) -> DataFrame:
    return audit.check_bounds(flows.level_indicators(s.flow()), {"effectiveness": (0.0, 0.02)})


@query(_CLASSES + " SELECT 'income' AS dimension, sum(weight) AS value, sum(weight) AS expected, true AS ok FROM c WHERE is_flow UNION ALL SELECT 'education', sum(CASE WHEN age >= 25 THEN weight END), sum(weight), abs(sum(CASE WHEN age >= 25 THEN weight END) - sum(weight)) < 1e-6 FROM c WHERE is_flow")
def check_profile(s: Survey) -> DataFrame:
    profile = estimate.long_profile(_classified(s).filter("is_flow"), ["unit"], ["education", "income"], {"education": F.col("age") >= 25})
    return audit.check_profile(profile, s.flow())


@query()
def linked_suppression(s: Survey) -> DataFrame:
    """Every edition's flows with what is hidden so that neither cells nor the margins beside them tell a hidden one (no SQL twin: rounds)."""
    cells, margins = linked.protect_margins(_edition_cells(s), ["edition"])
    for end in ("o", "d"):
        side = margins.filter(F.col("side") == end).select("edition", F.col("unit").alias(end), F.col("published").alias(f"{end}_published"))
        cells = cells.join(side, ["edition", end])
    return cells.select("edition", "o", "d", "total", "n", "n_psu", "hidden", "o_published", "d_published")


_OBSERVED = [("rows", "count(*)", 1.0, None), ("weight", "sum(weight)", 1.0, None), ("households", "count(psu)", 1.0, None), ("unknown_flags", "count(CASE WHEN is_flow IS NULL THEN 1 END)", None, 0.0), ("loops", "count(CASE WHEN is_flow AND prev_unit = unit THEN 1 END)", None, 0.0), ("oldest", "max(age)", None, 89.0)]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({value} AS DOUBLE) AS value, CAST({'NULL' if low is None else low} AS DOUBLE) AS low, CAST({'NULL' if high is None else high} AS DOUBLE) AS high, coalesce({value} >= {'-1e300' if low is None else low} AND {value} <= {'1e300' if high is None else high}, false) AS ok FROM persons WHERE age IS NOT NULL" for name, value, low, high in _OBSERVED) + ") UNION ALL SELECT 'read', CAST(count(*) AS DOUBLE), CAST(1 AS DOUBLE), NULL, count(*) >= 1 FROM persons")
def checks_while_writing(s: Survey) -> DataFrame:
    """Checks of the persons gathered in the one pass that writes them."""
    checks = [files.Check(name, F.expr(value), low, high) for name, value, low, high in _OBSERVED]
    path = f"{store.shared_folder(s.spark)}/{uuid.uuid4().hex}"
    return files.write_checked(s.persons, path, checks, [files.Check("read", F.count(F.lit(1)), 1.0)], F.col("age").isNotNull())

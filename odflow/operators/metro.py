"""Commuting and metropolitan regions.

Persons have, besides the survey's columns, the flags of ``flag_commuters``. Members of regions are (metro, unit, is_core,
kind, pop); a region has one core. Dimensions are joined by their keys, and Spark broadcasts them by their size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.recode import core_periphery, flag, work_class
from odflow.operators.estimate import cell_estimate, cell_variance, long_profile, se_cv, weighted_share
from odflow.operators.flows import ends

#: Codes of transport modes that count as public.
PUBLIC = ("03", "04", "05", "06")


def flag_commuters(persons: DataFrame, public: Sequence[str] = PUBLIC) -> DataFrame:
    """employed, commutes, student, commutes_study, daily, public: unknown is false. A commuter works or studies in another known unit."""
    work = (F.col("work_local") == "3") & (F.col("work_unit") != "99") & (F.col("work_unit") != F.col("unit"))
    study = (F.col("study_local") == "2") & (F.col("study_unit") != "99") & (F.col("study_unit") != F.col("unit"))
    return persons.withColumns({
        "employed": flag(F.col("employed_code") == "1"), "commutes": flag(work), "student": flag(F.col("school_code") == "1"),
        "commutes_study": flag(study), "daily": flag(F.col("daily_code") == "1"), "public": flag(F.col("mode_code").isin(*public)),
    })


def _commuters(persons: DataFrame, purpose: str) -> DataFrame:
    who = (F.col("employed") & F.col("commutes")) if purpose == "work" else (F.col("student") & F.col("commutes_study"))
    return persons.filter(who).withColumnsRenamed({"unit": "o", f"{purpose}_unit": "d"})


def commute_matrix(persons: DataFrame, frame: DataFrame, purpose: str = "work") -> DataFrame:
    """o, d, total, n, n_psu, variance, se, cv of commuters; for work also minutes (unweighted median), pct_daily, pct_public.

    The median is kept as counts of values while it is aggregated, so a pair of any size stays small.
    """
    rows = _commuters(persons, purpose)
    cells = se_cv(cell_variance(rows.select("o", "d", "stratum", "psu", "weight"), ["o", "d"], frame))
    if purpose != "work":
        return cells
    more = rows.groupBy("o", "d").agg(F.median("commute_min").alias("minutes"), weighted_share(F.col("daily")).alias("pct_daily"), weighted_share(F.col("public")).alias("pct_public"))
    return cells.join(more, ["o", "d"])


def commute_profile(persons: DataFrame, dims: Sequence[str], purpose: str = "work", universes: Mapping[str, Column] = {}, unknown: str = "unknown") -> DataFrame:
    """(o, d, dimension, category) -> total, n, n_psu of commuters; a missing category is ``unknown``."""
    rows = _commuters(persons, purpose).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in dims})
    return long_profile(rows, ["o", "d"], dims, universes)


def commute_indicators(persons: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row a unit of residence (and keys): employed, students, commuters out and in, balance, rate out (%) and attraction."""
    w = lambda p: F.coalesce(F.sum(F.when(p, F.col("weight"))), F.lit(0.0))
    out = F.col("employed") & F.col("commutes")
    at = [*keys, "unit"]
    here = persons.groupBy(*at).agg(
        w(F.col("employed")).alias("employed"), w(F.col("student")).alias("students"), w(out).alias("out_work"), F.count(F.when(out, 1)).alias("n_out"),
        w(F.col("employed") & F.col("work_local").isin("1", "2")).alias("work_here"), w(F.col("employed") & (F.col("work_local") == "5")).alias("several"),
        w(F.col("employed") & (F.col("work_local") == "4")).alias("abroad"), w(F.col("student") & F.col("commutes_study")).alias("out_study"),
        F.median(F.when(out, F.col("commute_min"))).alias("minutes"), w(out & F.col("daily")).alias("w_daily"), w(out & F.col("public")).alias("w_public"),
    )
    into = _commuters(persons, "work").groupBy(*keys, F.col("d").alias("unit")).agg(F.sum("weight").alias("in_work"), F.count(F.lit(1)).alias("n_in"))
    study = _commuters(persons, "study").groupBy(*keys, F.col("d").alias("unit")).agg(F.sum("weight").alias("in_study"))
    rows = here.join(into, at, "left").join(study, at, "left").fillna(0, ["in_work", "n_in", "in_study"])
    share = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return rows.select(
        *at, "employed", "students", "out_work", "in_work", (F.col("in_work") - F.col("out_work")).alias("balance"), "out_study", "in_study", "several", "abroad", "n_out", "n_in",
        share(100 * F.col("out_work"), "employed").alias("rate_out"), share(F.col("work_here") + F.col("in_work"), "employed").alias("attraction"),
        "minutes", share(100 * F.col("w_daily"), "out_work").alias("pct_daily"), share(100 * F.col("w_public"), "out_work").alias("pct_public"),
    )


def metro_members(dim: DataFrame, cores: DataFrame, pop: DataFrame, name: str = "metro", development: str = "%integrada de desenvolvimento%") -> DataFrame:
    """(metro, unit, is_core, kind, pop) of regions that have a core; kind by the region's name."""
    rows = dim.filter("metro is not null").join(cores.select("metro", "core"), "metro").join(pop.select("unit", "pop"), "unit", "left")
    kind = F.when(F.col(name).ilike(development), F.lit("development")).otherwise(F.lit("metropolitan"))
    return rows.select("metro", "unit", (F.col("unit") == F.col("core")).alias("is_core"), kind.alias("kind"), "pop")


@cache
def _accents() -> tuple[str, str]:
    """Lower-case letters that Unicode takes apart into one plain Latin letter and marks, and those letters."""
    found = {}
    for c in map(chr, range(0x80, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1 and plain.isascii() and plain.islower() and plain.isalpha():
            found[c] = plain
    return "".join(found), "".join(found.values())


def infer_core(members: DataFrame) -> DataFrame:
    """(metro, core): the most populous member whose name's words stand in a row in the region's name, else the most populous.

    members: metro, metro_name, unit, unit_name, pop. Names are compared without accents and case. Ties: most words, then
    population (nulls last), then the higher code.
    """
    plain = lambda c: F.split(F.trim(F.regexp_replace(F.translate(F.lower(c), *_accents()), "[^a-z0-9]+", " ")), " ")
    m = members.withColumn("own", plain(F.col("unit_name"))).withColumn("all", plain(F.col("metro_name")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - F.size("own") + 1, F.lit(1)))
    held = (F.size("own") <= F.size("all")) & F.exists(starts, lambda i: F.slice("all", i, F.size("own")) == F.col("own"))
    place = F.row_number().over(Window.partitionBy("metro").orderBy(F.desc("named"), F.desc(F.when(F.col("named"), F.size("own")).otherwise(0)), F.desc_nulls_last("pop"), F.desc("unit")))
    return m.withColumn("named", held).withColumn("place", place).filter("place = 1").select("metro", F.col("unit").alias("core"), "named")


def intra_movers(persons: DataFrame, members: DataFrame) -> DataFrame:
    """Movers with both ends in one region: metro, core, o_core and d_core beside the person's columns."""
    o = members.select(F.col("metro"), F.col("unit").alias("prev_unit"), F.col("is_core").alias("o_core"))
    d = members.select("metro", "unit", F.col("is_core").alias("d_core"))
    core = members.filter("is_core").select("metro", F.col("unit").alias("core"))
    return persons.filter("is_flow").join(o, "prev_unit").join(d, ["metro", "unit"]).join(core, "metro", "left")


def metro_flows(movers: DataFrame, frame: DataFrame) -> DataFrame:
    """(metro, o, d) -> kind, total, n, n_psu, variance, se, cv of ``intra_movers``."""
    rows = movers.select("metro", F.col("prev_unit").alias("o"), F.col("unit").alias("d"), core_periphery("o_core", "d_core").alias("kind"), "stratum", "psu", "weight")
    return se_cv(cell_variance(rows, ["metro", "o", "d", "kind"], frame))


def move_commute_triples(movers: DataFrame) -> DataFrame:
    """(metro, o, d, work, class) -> total, n, n_psu, pct_daily, pct_public of the employed movers: lived in, lives in, works in."""
    rows = movers.filter("employed").select(
        "metro", F.col("prev_unit").alias("o"), F.col("unit").alias("d"), F.when(F.col("commutes"), F.col("work_unit")).alias("work"),
        work_class("commutes", "work_unit", "prev_unit", "core", "work_local").alias("class"), "psu", "weight", "daily", "public",
    )
    by_psu = rows.groupBy("metro", "o", "d", "work", "class", "psu").agg(
        F.sum("weight").alias("z"), F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col(c), F.col("weight")).otherwise(0.0)).alias(c) for c in ("daily", "public"))
    )
    share = lambda c: (100 * F.sum(c) / F.sum("z")).alias(f"pct_{c}")
    return by_psu.groupBy("metro", "o", "d", "work", "class").agg(F.sum("z").alias("total"), F.sum("n").alias("n"), F.count("psu").alias("n_psu"), share("daily"), share("public"))


def triple_summary(movers: DataFrame) -> DataFrame:
    """(metro, unit): movers of the region, employed and commuting ones by class of work place, students; one pass."""
    kind = work_class("commutes", "work_unit", "prev_unit", "core", "work_local")
    m = movers.withColumn("class", F.when(F.col("employed"), kind))
    w = lambda p: F.coalesce(F.sum(F.when(p, F.col("weight"))), F.lit(0.0))
    going = F.col("employed") & F.col("commutes")
    rows = m.groupBy("metro", "unit").agg(
        F.sum("weight").alias("movers"), F.count(F.lit(1)).alias("n_movers"), w(F.col("employed")).alias("employed"), w(going).alias("commuting"), F.count(F.when(going, 1)).alias("n_commuting"),
        *(w(F.col("class") == c).alias(f"to_{c}") for c in ("origin", "core", "other", "own")), F.median(F.when(going, F.col("commute_min"))).alias("minutes"),
        w(F.col("student")).alias("students"), w(F.col("student") & F.col("commutes_study")).alias("students_commuting"),
    )
    return rows.withColumn("pct_commuting", F.when(F.col("employed") > 0, 100 * F.col("commuting") / F.col("employed")))


def move_study_triples(movers: DataFrame) -> DataFrame:
    """(metro, o, d, study, class) -> total, n, n_psu of movers who study."""
    away = F.col("commutes_study")
    kind = F.when(away & (F.col("study_unit") == F.col("prev_unit")), "origin").when(away & (F.col("study_unit") == F.col("core")), "core").when(away, "other").otherwise("own")
    rows = movers.filter("student").select("metro", F.col("prev_unit").alias("o"), F.col("unit").alias("d"), F.when(away, F.col("study_unit")).alias("study"), kind.alias("class"), "psu", "weight")
    return cell_estimate(rows, ["metro", "o", "d", "study", "class"])


def metro_summary(persons: DataFrame, members: DataFrame, movers: DataFrame) -> DataFrame:
    """A row a region: members, population, moves inside by kind, exchange with the rest of the country, commuters."""
    w = lambda p: F.coalesce(F.sum(F.when(p, F.col("weight"))), F.lit(0.0))
    size = members.groupBy("metro").agg(F.count(F.lit(1)).alias("units"), F.sum("pop").alias("pop"), F.max("kind").alias("kind"), F.max(F.when(F.col("is_core"), F.col("unit"))).alias("core"))
    kind = core_periphery("o_core", "d_core")
    inside = movers.groupBy("metro").agg(F.sum("weight").alias("moves"), *(w(kind == c).alias(c) for c in ("core_periphery", "periphery_core", "periphery_periphery")))
    here, there = members.select("unit", "metro"), members.select(F.col("unit").alias("prev_unit"), F.col("metro").alias("from_metro"))
    both = persons.join(here, "unit", "left").join(there, "prev_unit", "left")
    outside = F.col("is_flow") & ~F.col("metro").eqNullSafe(F.col("from_metro"))
    going = F.col("employed") & F.col("commutes")
    residents = both.filter("metro is not null").groupBy("metro").agg(
        w(outside).alias("inflow"), w(F.col("employed")).alias("employed"), w(going).alias("commuting"), F.median(F.when(going, F.col("commute_min"))).alias("minutes"),
        w(going & F.col("public")).alias("w_public"), w(going & F.col("daily")).alias("w_daily"),
    )
    left = both.filter(outside & F.col("from_metro").isNotNull()).groupBy(F.col("from_metro").alias("metro")).agg(F.sum("weight").alias("outflow"))
    rows = size.join(inside, "metro", "left").join(residents, "metro", "left").join(left, "metro", "left")
    sums = ["moves", "core_periphery", "periphery_core", "periphery_periphery", "inflow", "outflow", "employed", "commuting"]
    rows = rows.fillna(0.0, sums)
    share = lambda a, b: F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b))
    return rows.select("metro", "kind", "core", "units", "pop", *sums[:6], (F.col("inflow") - F.col("outflow")).alias("net"), "employed", "commuting", share("commuting", "employed").alias("pct_commuting"), "minutes", share("w_public", "commuting").alias("pct_public"), share("w_daily", "commuting").alias("pct_daily"))


def metro_boundary_flows(flows: DataFrame, members: DataFrame) -> DataFrame:
    """(metro, direction, o, d, total): commuting with exactly one end in a region, for all regions at once."""
    at = lambda end: members.select("metro", F.col("unit").alias(end), F.lit(True).alias(f"in_{end}"))
    out = flows.join(at("o"), "o").join(at("d").withColumnRenamed("metro", "other"), "d", "left").filter(~F.col("metro").eqNullSafe(F.col("other")))
    into = flows.join(at("d"), "d").join(at("o").withColumnRenamed("metro", "other"), "o", "left").filter(~F.col("metro").eqNullSafe(F.col("other")))
    columns = lambda df, way: df.select("metro", F.lit(way).alias("direction"), "o", "d", "total")
    return columns(out, "out").unionByName(columns(into, "in"))


def intra_net(flows: DataFrame) -> DataFrame:
    """(metro, unit, inflow, outflow, net, place): balance of each member in its region's own flows (metro, o, d, total), largest gain first."""
    sums = ends(flows.select("o", "d", "total", "metro")).groupBy("metro", "unit").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    rows = sums.withColumn("net", F.col("inflow") - F.col("outflow"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("metro").orderBy(F.desc("net"), "unit")))


def region_matrix(flows: DataFrame, groups: DataFrame) -> DataFrame:
    """(row, col, o, d, total) of every pair of groups (unit, region), ordered by region, then unit; absent flows are 0.

    Both sides of the frame are one small dimension.
    """
    placed = groups.select("unit", "region").distinct().withColumn("at", F.row_number().over(Window.orderBy("region", "unit")))
    o, d = placed.select(F.col("at").alias("row"), F.col("unit").alias("o")), placed.select(F.col("at").alias("col"), F.col("unit").alias("d"))
    cells = flows.groupBy("o", "d").agg(F.sum("total").alias("total"))
    return o.join(F.broadcast(d)).join(cells, ["o", "d"], "left").select("row", "col", "o", "d", F.coalesce("total", F.lit(0.0)).alias("total"))


def metro_rollup(indicators: DataFrame, members: DataFrame) -> DataFrame:
    """Commuting of a region's members added up: employed, out_work, in_work, students, out_study, rate_out (%)."""
    sums = ["employed", "out_work", "in_work", "students", "out_study"]
    rows = members.select("metro", "unit").join(indicators, "unit").groupBy("metro").agg(F.count(F.lit(1)).alias("units"), *(F.sum(c).alias(c) for c in sums))
    return rows.withColumn("rate_out", F.when(F.col("employed") > 0, 100 * F.col("out_work") / F.col("employed")))

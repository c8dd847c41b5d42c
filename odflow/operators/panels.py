"""Panels over editions: units, pairs, profiles, systems, and what may be compared with what.

Tables of all editions are one frame keyed by edition (and level), so a panel is a few joins and not a loop over editions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.recode import classify_effectiveness, flag, se_effectiveness
from odflow.operators.estimate import cell_variance, se_cv
from odflow.operators.flows import attach_ends, ends


def unit_series(flows: DataFrame, units: DataFrame, lineage: DataFrame, coverage: DataFrame, pop: DataFrame) -> DataFrame:
    """(unit, edition) for every unit of today and every edition: existed, state, inflow, outflow, net, turnover, effectiveness, net_rate, pairs.

    flows: edition, o, d, total; lineage: unit, edition, existed, parent; coverage: unit, edition, state; pop: unit, edition, pop5.
    Measures of a unit without flows in an edition are 0 if it existed, null if not.
    """
    e = ends(flows.select("o", "d", "total", "edition"))
    sums = e.groupBy("unit", "edition").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), F.count(F.when(F.col("inflow") + F.col("outflow") > 0, 1)).alias("pairs"))
    skeleton = units.select("unit").join(lineage.select("unit", "edition", "existed", "parent"), "unit")
    rows = skeleton.join(sums, ["unit", "edition"], "left").join(coverage.select("unit", "edition", "state"), ["unit", "edition"], "left").join(pop, ["unit", "edition"], "left")
    known = lambda c: F.coalesce(F.col(c), F.when(F.col("existed"), F.lit(0))).alias(c)
    rows = rows.select("unit", "edition", "existed", "parent", "state", "pop5", *(known(c) for c in ("inflow", "outflow", "pairs")))
    i, o = F.col("inflow"), F.col("outflow")
    return rows.withColumns({"net": i - o, "turnover": i + o, "effectiveness": F.when(i + o > 0, (i - o) / (i + o)), "net_rate": F.when(F.col("pop5") > 0, 1000 * (i - o) / F.col("pop5"))})


def to_edition_units(persons: DataFrame, lineage: DataFrame, columns: Sequence[str] = ("unit", "prev_unit")) -> DataFrame:
    """Persons with the units of their edition: a unit that did not exist is its parent of then (lineage: unit, edition, existed, parent)."""
    gone, out = lineage.filter("not existed").select("edition", "unit", "parent"), persons
    for c in columns:
        out = out.join(gone.select("edition", F.col("unit").alias(c), F.col("parent").alias(f"_{c}")), ["edition", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*persons.columns)


def level_cells(movers: DataFrame, dim: DataFrame, levels: Sequence[str], frame: DataFrame) -> DataFrame:
    """(level, edition, o, d) -> total, n, n_psu, variance, se, cv at units and at every level, in one pass over the movers.

    movers: edition, prev_unit, unit, stratum, psu, weight; strata are those of an edition. Moves inside a group are left out of its level.
    """
    both = attach_ends(movers.select("edition", "stratum", "psu", "weight", F.col("prev_unit").alias("o"), F.col("unit").alias("d")), dim, levels)
    at = [F.struct(F.lit("unit").alias("level"), F.col("o"), F.col("d")), *(F.struct(F.lit(x).alias("level"), F.col(f"o_{x}").alias("o"), F.col(f"d_{x}").alias("d")) for x in levels)]
    rows = both.select("edition", "stratum", "psu", "weight", F.explode(F.array(*at)).alias("x")).select("edition", "stratum", "psu", "weight", "x.*").filter("o <> d")
    return se_cv(cell_variance(rows, ["level", "edition", "o", "d"], frame))


def end_statistics(flows: DataFrame, keys: Sequence[str] = ("level", "edition")) -> DataFrame:
    """(keys, code) -> pairs, mean_km, median_km, gini_out, gini_in of positive flows (keys, o, d, total, km), from one sort.

    A flow counts at both ends. Each end gives its volume, in the direction's list, and its distance; equal values are counted before
    they are ordered, and one window over (keys, code, list) by value serves both indices and the median. km may be null.
    """
    e = ends(flows.filter("total > 0").select("o", "d", "total", "km", *keys)).withColumnRenamed("unit", "code")
    volume = F.col("inflow") + F.col("outflow")
    lists = F.array(F.struct(F.when(F.col("inflow") > 0, "in").otherwise("out").alias("list"), volume.alias("value")), F.struct(F.lit("km").alias("list"), F.col("km").cast("double").alias("value")))
    rows = e.select(*keys, "code", volume.alias("w"), F.explode(lists).alias("x")).select(*keys, "code", "w", "x.*").filter("value is not null")
    counted = rows.groupBy(*keys, "code", "list", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"))
    own = Window.partitionBy(*keys, "code", "list")
    run = own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.select("*", (F.sum("c").over(run) - F.col("c")).alias("before"), F.sum("w").over(run).alias("upto"), F.sum("c").over(own).alias("n"), F.sum("w").over(own).alias("all"))
    on = lambda name, x: F.when(F.col("list") == name, x)
    spread = F.col("value") * F.col("c") * (2 * F.col("before") + F.col("c") - F.col("n"))
    gini = lambda name: F.try_divide(F.sum(on(name, spread)), F.max(on(name, F.col("n") * F.col("all")))).alias(f"gini_{name}")
    return placed.groupBy(*keys, "code").agg(
        F.sum(F.when(F.col("list") != "km", F.col("c"))).alias("pairs"), F.try_divide(F.sum(on("km", F.col("value") * F.col("w"))), F.max(on("km", F.col("all")))).alias("mean_km"),
        F.min(on("km", F.when(F.col("upto") >= 0.5 * F.col("all"), F.col("value")))).alias("median_km"), gini("out"), gini("in"),
    )


def unit_panel(skeleton: DataFrame, flows: DataFrame, pop: DataFrame, borders: DataFrame, errors: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """Every unit and group of today in every edition: its coverage and, where it was there, its measures.

    skeleton: level, code, edition, present (units of it that existed) and any columns of coverage; flows: level, edition, o, d, total, se,
    km; pop: level, code, edition, pop, pop5; borders: level, code, border (the coarser area whose border a flow may cross);
    errors: edition, code, se_in, se_out of single units. Groups have the root of the sum of their flows' squared errors.
    outside: level, edition, code, inflow, outflow of groups without flows of their own; they have no error, distance or index.

    Beside the skeleton: pop, pop5, inflow, outflow, net, in_rate, out_rate, net_rate, effectiveness, se_in, se_out, se_effectiveness, kind,
    turnover, turnover_rate, pairs, mean_km, median_km, gini_out, gini_in, cross. Measures of what was not there are null; counts
    and volumes of what was there and had no flows are 0.
    """
    at = ["level", "edition", "code"]
    side = lambda df, end: df.select("level", "edition", F.col(end).alias("code"), F.col(f"border_{end}").alias("own"), F.col(f"border_{'o' if end == 'd' else 'd'}").alias("other"), F.lit(end).alias("end"), "total", "se")
    marked = flows
    for end in ("o", "d"):
        marked = marked.join(borders.select("level", F.col("code").alias(end), F.col("border").alias(f"border_{end}")), ["level", end], "left")
    both = side(marked, "d").unionByName(side(marked, "o"))
    way = lambda end, x: F.coalesce(F.sum(F.when(F.col("end") == end, x)), F.lit(0.0))
    square = F.coalesce(F.col("se") * F.col("se"), F.lit(0.0))
    crossed = F.sum(F.when(~F.col("own").eqNullSafe(F.col("other")), F.col("total")).otherwise(0.0))
    sums = both.groupBy(*at).agg(way("d", F.col("total")).alias("inflow"), way("o", F.col("total")).alias("outflow"), F.sqrt(way("d", square)).alias("_in"), F.sqrt(way("o", square)).alias("_out"), F.try_divide(crossed, F.sum("total")).alias("cross"))
    sums = sums.withColumn("_own", F.lit(True))
    if outside is not None:
        sums = sums.unionByName(outside.select(*at, "inflow", "outflow", F.lit(False).alias("_own")), allowMissingColumns=True)
        led = outside.select("level").distinct().withColumn("_led", F.lit(True))
    known = errors.select(F.lit("unit").alias("level"), "edition", "code", "se_in", "se_out")
    rows = skeleton.join(pop.select(*at, "pop", "pop5"), at, "left").join(sums, at, "left").join(known, at, "left").join(end_statistics(flows), at, "left")
    rows = rows.join(F.broadcast(led), "level", "left") if outside is not None else rows.withColumn("_led", F.lit(None).cast("boolean"))
    there, own = F.col("present") > 0, ~F.coalesce("_led", F.lit(False))
    zero = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(0.0)))
    i, o = zero("inflow"), zero("outflow")
    se = lambda end: F.when(there & own, F.coalesce(f"se_{end}", F.when(F.col("level") != "unit", F.col(f"_{end}")), F.lit(0.0)))
    rate = lambda x: F.when(F.col("pop5") > 0, 1000 * x / F.col("pop5"))
    measures = F.when(i + o > 0, (i - o) / (i + o))
    out = rows.select(
        *skeleton.columns, "pop", "pop5", i.alias("inflow"), o.alias("outflow"), (i - o).alias("net"), rate(i).alias("in_rate"), rate(o).alias("out_rate"), rate(i - o).alias("net_rate"),
        measures.alias("effectiveness"), se("in").alias("se_in"), se("out").alias("se_out"), (i + o).alias("turnover"), rate(i + o).alias("turnover_rate"),
        F.when(there & own, F.coalesce("pairs", F.lit(0))).alias("pairs"), "mean_km", "median_km", "gini_out", "gini_in", "cross",
    )
    out = out.withColumn("se_effectiveness", se_effectiveness("inflow", "outflow", "se_in", "se_out"))
    return out.withColumn("kind", classify_effectiveness("effectiveness", "se_effectiveness"))


def pair_series(flows: DataFrame, universe: DataFrame, lineage: DataFrame, asked: DataFrame) -> DataFrame:
    """(o, d, edition, total, absence, place): each pair in each edition, with the reason where it has no value.

    flows: edition, o, d, total; universe: o, d; lineage: unit, edition, existed; asked: edition, asked. The reasons: not_asked, did_not_exist
    (either end; a unit without a row existed), suppressed. place: rank among the origin's destinations, ties share the least.
    """
    rows = universe.select("o", "d").join(F.broadcast(asked.select("edition", "asked")))
    for end in ("o", "d"):
        rows = rows.join(lineage.select(F.col("unit").alias(end), "edition", F.col("existed").alias(f"_{end}")), [end, "edition"], "left")
    rows = rows.join(flows.select("edition", "o", "d", "total"), ["edition", "o", "d"], "left")
    there = F.coalesce("_o", F.lit(True)) & F.coalesce("_d", F.lit(True))
    absence = F.when(F.col("total").isNull(), F.when(~F.col("asked"), "not_asked").when(~there, "did_not_exist").otherwise("suppressed"))
    place = F.when(F.col("total").isNotNull(), F.rank().over(Window.partitionBy("edition", "o").orderBy(F.desc_nulls_last("total"))))
    return rows.select("o", "d", "edition", "total", absence.alias("absence"), place.alias("place"))


def profile_series(profile: DataFrame, dim: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(level, code, edition, dimension, category, total, caveat): units as they are, groups as sums of shown cells, with a caveat.

    One explode gives a row its groups, one aggregation sums all levels.
    """
    own = profile.select(F.lit("unit").alias("level"), F.col("unit").alias("code"), "edition", "dimension", "category", "total", F.lit(False).alias("caveat"))
    groups = F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).alias("code")) for x in levels))).alias("g")
    rows = profile.join(dim.select("unit", *levels), "unit").select(groups, "edition", "dimension", "category", "total").filter("g.code is not null")
    sums = rows.groupBy("g.level", "g.code", "edition", "dimension", "category").agg(F.sum("total").alias("total")).withColumn("caveat", F.lit(True))
    return own.unionByName(sums)


def system_series(flows: DataFrame, pop: DataFrame) -> DataFrame:
    """(level, edition, units, moves, cmi, mei, anmr) of flows of all levels and editions (level, edition, o, d, total); pop: edition, pop."""
    e = ends(flows.select("o", "d", "total", "level", "edition")).groupBy("level", "edition", "unit").agg(F.sum("inflow").alias("i"), F.sum("outflow").alias("o"))
    s = e.groupBy("level", "edition").agg(F.count(F.lit(1)).alias("units"), F.sum("i").alias("moves"), F.sum(F.abs(F.col("i") - F.col("o"))).alias("spread")).join(pop.select("edition", "pop"), "edition", "left")
    per = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return s.select("level", "edition", "units", "moves", per(100 * F.col("moves"), "pop").alias("cmi"), per(50 * F.col("spread"), "moves").alias("mei"), per(50 * F.col("spread"), "pop").alias("anmr"))


def slope_by(units: DataFrame, keys: Sequence[str], y: str, density: str, pop: str) -> DataFrame:
    """(keys, n, slope, se): for each group, the population-weighted regression of a rate on log10 density.

    Two passes, as near-exact fits need: sums give the means, centred sums the line and a third its squared residuals. A group of fewer
    than three units of positive density and population, or of one density, has nulls. Results of a pass have one row a group.
    """
    c = F.col
    known = units.filter(f"{y} is not null and {density} > 0 and {pop} > 0").select(*keys, F.log10(density).alias("x"), F.col(y).alias("y"), F.col(pop).alias("w"))
    means = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(c("w") * c("x")) / F.sum("w")).alias("mx"), (F.sum(c("w") * c("y")) / F.sum("w")).alias("my"))
    centred = known.join(means, list(keys)).select(*keys, "w", (c("x") - c("mx")).alias("x"), (c("y") - c("my")).alias("y"))
    line = centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(c("w") * c("x") * c("x")).alias("sxx"), F.sum(c("w") * c("x") * c("y")).alias("sxy"))
    line = line.select(*keys, "n", "sxx", F.when((c("n") >= 3) & (c("sxx") > 0), c("sxy") / c("sxx")).alias("slope"))
    off = c("y") - c("slope") * c("x")
    left = centred.join(line, list(keys)).groupBy(*keys).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("sxx").alias("sxx"), F.sum(c("w") * off * off).alias("ss"))
    return left.select(*keys, "n", "slope", F.when(c("slope").isNotNull(), F.sqrt(c("ss") / (c("n") - 2) / c("sxx"))).alias("se"))


def dissimilarity_series(flows: DataFrame) -> DataFrame:
    """(level, edition, dissimilarity): half the sum of |p - q| of each edition's flows and those of the level's edition before it.

    The first edition of a level has no row. A flow gives its share to its own edition and, negative, to the next one; what meets
    there is summed by pair, so the whole series is one grouping of twice its rows.
    """
    at = ["level", "edition"]
    whole = flows.groupBy(*at).agg(F.sum("total").alias("s"))
    order = Window.partitionBy("level").orderBy("edition")
    whole = whole.select("*", F.lead("edition").over(order).alias("next"), F.lag("s").over(order).alias("before"))
    shares = flows.join(whole, at).select("level", "o", "d", "edition", "next", F.try_divide("total", "s").alias("p"))
    both = shares.select("level", "o", "d", F.explode(F.array(F.struct("edition", "p"), F.struct(F.col("next").alias("edition"), (-F.col("p")).alias("p")))).alias("x")).select("level", "o", "d", "x.*").filter("edition is not null")
    met = both.groupBy(*at, "o", "d").agg(F.sum("p").alias("p")).groupBy(*at).agg((0.5 * F.sum(F.abs("p"))).alias("v"))
    return whole.filter("before is not null").join(met, at).select(*at, F.when((F.col("s") > 0) & (F.col("before") > 0), F.col("v")).alias("dissimilarity"))


def system_panel(units: DataFrame, flows: DataFrame, smi: DataFrame, smi_level: str = "unit") -> DataFrame:
    """One row a level and edition: units, moves, cmi, smi, mei, anmr, slope, slope_se, dissimilarity from the edition before.

    units: level, edition, code, pop, pop5, net, area of the units that were there; flows: level, edition, o, d, total; smi: edition, smi,
    which belongs to ``smi_level`` alone. Levels and editions with units have a row, those without flows 0 moves.
    """
    at = ["level", "edition"]
    u = units.groupBy(*at).agg(F.count(F.lit(1)).alias("units"), F.sum("pop").alias("pop"), F.sum(F.abs("net")).alias("spread"))
    m = flows.groupBy(*at).agg(F.sum("total").alias("moves"))
    dense = units.filter("pop > 0 and area > 0").withColumns({"density": F.col("pop") / F.col("area"), "rate": F.when(F.col("pop5") > 0, 1000 * F.col("net") / F.col("pop5"))})
    fit = slope_by(dense, at, "rate", "density", "pop").select(*at, "slope", F.col("se").alias("slope_se"))
    rows = u.join(m, at, "left").fillna(0.0, ["moves"]).join(fit, at, "left").join(dissimilarity_series(flows), at, "left").join(smi.select("edition", "smi"), "edition", "left")
    cmi, mei = F.try_divide(100 * F.col("moves"), "pop"), F.try_divide(50 * F.col("spread"), "moves")
    return rows.select(*at, "units", "moves", cmi.alias("cmi"), F.when(F.col("level") == smi_level, F.col("smi")).alias("smi"), mei.alias("mei"), (cmi * mei / 100).alias("anmr"), "slope", "slope_se", "dissimilarity")


def loglinear_series(flows: DataFrame, coding: str = "total") -> DataFrame:
    """(level, edition, o, d, total, t, o_effect, d_effect, od_effect) of positive flows, systems of at least 2 x 2 only.

    coding "total": t the sum, o and d the shares of the margins, od observed over expected. coding "geometric": t the
    geometric mean of the positive cells, both effects 1, od the cell over t.
    """
    f = flows.filter("total > 0").select("level", "edition", "o", "d", "total")
    at = ["level", "edition"]
    whole = f.groupBy(*at).agg(F.sum("total").alias("s"), F.exp(F.avg(F.log("total"))).alias("g"), F.countDistinct("o").alias("no"), F.countDistinct("d").alias("nd")).filter("no >= 2 and nd >= 2")
    if coding == "geometric":
        one = F.lit(1.0)
        return f.join(whole, at).select(*at, "o", "d", "total", F.col("g").alias("t"), one.alias("o_effect"), one.alias("d_effect"), (F.col("total") / F.col("g")).alias("od_effect"))
    rows, cols = f.groupBy(*at, "o").agg(F.sum("total").alias("ro")), f.groupBy(*at, "d").agg(F.sum("total").alias("cd"))
    j = f.join(whole, at).join(rows, [*at, "o"]).join(cols, [*at, "d"])
    return j.select(*at, "o", "d", "total", F.col("s").alias("t"), (F.col("ro") / F.col("s")).alias("o_effect"), (F.col("cd") / F.col("s")).alias("d_effect"), (F.col("total") * F.col("s") / (F.col("ro") * F.col("cd"))).alias("od_effect"))


def calibrate(df: DataFrame, factors: DataFrame) -> DataFrame:
    """calibrated beside value: divided by the factor of the measure and level, else of the measure (level null); null without one.

    factors: measure, level, factor, applies; a factor that does not apply is only documented.
    """
    use = factors.filter("applies").select("measure", "level", "factor")
    own = use.filter("level is not null").withColumnRenamed("factor", "_own")
    wide = use.filter("level is null").select("measure", F.col("factor").alias("_wide"))
    j = df.join(own, ["measure", "level"], "left").join(wide, "measure", "left")
    return j.withColumn("calibrated", F.col("value") / F.coalesce("_own", "_wide")).drop("_own", "_wide")


def evaluate_proxy(df: DataFrame, truth: str, proxy: str, rates: DataFrame | None = None) -> DataFrame:
    """One row: weights by truth and proxy origin (null: no mover), capture, false positives, agreement of origins in percent.

    With ``rates`` (true, proxy) of units also their correlation, the slope of the proxy on the truth, and the share of signs turned over.
    """
    w = lambda p: F.coalesce(F.sum(F.when(p, F.col("weight"))), F.lit(0.0))
    t, p = F.col(truth).isNotNull(), F.col(proxy).isNotNull()
    s = df.agg(w(t).alias("t"), w(p).alias("p"), w(t & p).alias("both"), w(t & p & (F.col(truth) == F.col(proxy))).alias("same"))
    share = lambda a, b: F.when(F.col(b) > 0, 100 * a / F.col(b))
    out = s.select(F.col("t").alias("true_movers"), F.col("p").alias("proxy_movers"), share(F.col("both"), "t").alias("capture"), share(F.col("p") - F.col("both"), "p").alias("false_positive"), share(F.col("same"), "both").alias("same_origin"))
    if rates is None:
        return out
    turned = F.count(F.when(F.signum("true") * F.signum("proxy") < 0, 1)) / F.count(F.lit(1))
    return out.join(F.broadcast(rates.agg(F.corr("true", "proxy").alias("correlation"), F.regr_slope("proxy", "true").alias("attenuation"), turned.alias("turned"))))


def comparability(measures: DataFrame, capabilities: DataFrame, exceptions: DataFrame, caveats: Mapping[str, str] = {}, units: DataFrame | None = None, changing: Sequence[str] = (), stable: Mapping[str, int] = {}, note: str = "number_of_units") -> DataFrame:
    """(measure, level, edition, state, note) of every measure, level and edition.

    measures: measure, levels array, requires array; capabilities: edition, has array, partial array; exceptions: measure, edition, state, note.
    Precedence: the level lacks the measure (no row), a requirement is missing, a stated exception, a requirement met in part, comparable.
    ``caveats`` names the note of each requirement that may be met in part.

    With ``units`` (level, edition, units) the number of units tells too, over all states but not_comparable: a measure of ``changing`` has a
    caveat where an edition has another number of units than the latest one has at that level, one of ``stable`` where it has fewer than
    the number given there.
    """
    rows = measures.select("measure", "requires", F.explode("levels").alias("level")).join(F.broadcast(capabilities.select("edition", "has", "partial")))
    rows = rows.join(exceptions.select("measure", "edition", F.col("state").alias("_state"), F.col("note").alias("_note")), ["measure", "edition"], "left")
    missing = F.array_except(F.array_except("requires", "has"), "partial")
    partly = F.array_intersect("requires", "partial")
    named = F.create_map(*[F.lit(x) for pair in caveats.items() for x in pair])[F.get(partly, F.lit(0))] if caveats else F.get(partly, F.lit(0))
    state = F.when(F.size(missing) > 0, "not_comparable").when(F.col("_state").isNotNull(), F.col("_state")).when(F.size(partly) > 0, "with_caveat").otherwise("comparable")
    notes = F.when(F.size(missing) > 0, F.get(missing, F.lit(0))).when(F.col("_state").isNotNull(), F.col("_note")).when(F.size(partly) > 0, named)
    out = rows.select("measure", "level", "edition", state.alias("state"), notes.alias("note"))
    if units is None:
        return out
    latest = units.groupBy("level").agg(F.max_by("units", "edition").alias("_latest"))
    out = out.join(units.select("level", "edition", "units").join(latest, "level"), ["level", "edition"], "left")
    least = F.coalesce(*(F.when(F.col("measure") == m, F.lit(n)) for m, n in stable.items()), F.lit(0))
    moved = (F.col("units") < least) | (F.col("measure").isin(*changing) & (F.col("units") != F.col("_latest")))
    turned = flag(moved) & (F.col("state") != "not_comparable")
    return out.select("measure", "level", "edition", F.when(turned, "with_caveat").otherwise(F.col("state")).alias("state"), F.when(turned, note).otherwise(F.col("note")).alias("note"))


def across_levels(measures: DataFrame, free: Sequence[str], steady: Sequence[str] = ()) -> DataFrame:
    """(measure, state, note): whether a measure may be read across levels. Only those of ``free`` may: their scale does not depend on the
    number of units. ``steady`` ones of them are indices that settle from some number of units on; the rest is not comparable."""
    m = F.col("measure")
    ok = m.isin(*free)
    note = F.when(~ok, "depends_on_scale").when(m.isin(*steady), "settles_with_units")
    return measures.select("measure", F.when(ok, "comparable").otherwise("not_comparable").alias("state"), note.alias("note"))


def assign_parent(units: DataFrame, old: DataFrame, overlaps: DataFrame, nearest: DataFrame, single: float = 0.90) -> DataFrame:
    """(unit, existed, parent, method) against an older mesh: same code, largest share of area, nearest, or none.

    units, old: unit; overlaps: unit, parent, share of the unit's area; nearest: unit, parent. A largest share below ``single`` means
    several parents; ties go to the smaller code.
    """
    same = old.select("unit").distinct().withColumn("_same", F.lit(True))
    best = overlaps.filter("share > 0").groupBy("unit").agg(F.min(F.struct(-F.col("share"), "parent")).alias("b")).select("unit", (-F.col("b.col1")).alias("share"), F.col("b.parent").alias("_by_area"))
    near = nearest.groupBy("unit").agg(F.min("parent").alias("_near"))
    j = units.select("unit").join(same, "unit", "left").join(best, "unit", "left").join(near, "unit", "left")
    there = F.coalesce("_same", F.lit(False))
    method = F.when(there, "existed").when(F.col("_by_area").isNotNull(), F.when(F.col("share") >= single, "single_parent").otherwise("several_parents")).when(F.col("_near").isNotNull(), "nearest").otherwise("none")
    return j.select("unit", there.alias("existed"), F.when(~there, F.coalesce("_by_area", "_near")).alias("parent"), method.alias("method"))


def grid_overlap(new_hits: DataFrame, old_hits: DataFrame) -> DataFrame:
    """(unit, parent, share): part of the grid points (point, unit) of a new unit that lie in each old one."""
    n = new_hits.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    both = new_hits.select("point", "unit").join(old_hits.select("point", F.col("unit").alias("parent")), "point").groupBy("unit", "parent").agg(F.count(F.lit(1)).alias("k"))
    return both.join(n, "unit").select("unit", "parent", (F.col("k") / F.col("n")).alias("share"))


def union_box(boxes: DataFrame, keys: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """West, south, east, north of a group's boxes, widened around the middle to sides of at least ``least``."""
    u = boxes.groupBy(*keys).agg(F.min("west").alias("w"), F.min("south").alias("s"), F.max("east").alias("e"), F.max("north").alias("n"))
    add = lambda lo, hi: F.greatest(F.lit(0.0), (least - (F.col(hi) - F.col(lo))) / 2)
    return u.select(*keys, (F.col("w") - add("w", "e")).alias("west"), (F.col("s") - add("s", "n")).alias("south"), (F.col("e") + add("w", "e")).alias("east"), (F.col("n") + add("s", "n")).alias("north"))

"""Lookups, rankings and measures read off published tables: attributes of households, partners, breaks, standard rates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.recode import recode
from odflow.operators.flows import attach_ends, ends, top_partners, weighted_median
from odflow.operators.ranks import numbered, values_at


def attach_household(persons: DataFrame, households: DataFrame, psu: str = "psu") -> DataFrame:
    """Persons with their household's columns; persons without one keep nulls."""
    return persons.join(households, psu, "left")


def per_capita(persons: DataFrame, households: DataFrame, total: str, eligible: Column, psu: str = "psu") -> DataFrame:
    """Persons with per_capita: the household's total over its eligible members; null without any."""
    heads = persons.groupBy(psu).agg(F.count(F.when(eligible, 1)).alias("_heads"))
    rates = households.select(psu, total).join(heads, psu).select(psu, F.when(F.col("_heads") > 0, F.col(total) / F.col("_heads")).alias("per_capita"))
    return persons.join(rates, psu, "left")


def spine_join(dim: DataFrame, parts: Sequence[DataFrame], key: str = "unit", fill: float = 0.0) -> DataFrame:
    """Every row of the dimension with the columns of each part; numbers that are missing are ``fill``."""
    out = dim
    for part in parts:
        out = out.join(part, key, "left")
    return out.fillna(fill, [c for p in parts for c in p.columns if c != key])


def conditional_lookup(df: DataFrame, lookup: DataFrame, key: Column, guard: Column, code: str = "code", value: str = "value", name: str = "found") -> DataFrame:
    """The lookup's value for a key made from several columns, where the guard holds; null elsewhere."""
    side = lookup.select(F.col(code).alias("_key"), F.col(value).alias(name))
    return df.withColumn("_key", F.when(guard, key)).join(side, "_key", "left").drop("_key")


def nearest(points: DataFrame, targets: DataFrame, levels: int | None = None) -> DataFrame:
    """(point, target, distance): the nearest target of each point (point, x, y; target, tx, ty), ties to the smaller code.

    Every point with coordinates has a row, however far it lies, unless there is no target with coordinates. Targets are laid in a
    tree of squares, four by four in each, that keeps the box around the targets of every square. A point goes down the tree from
    the root and keeps the squares that may hold its nearest target: their boxes are not farther than the farthest corner of
    the best one. So far and clustered targets cost no more than close ones. ``levels``: depth of the tree, by the number of
    targets if None.
    """
    t = targets.filter("tx is not null and ty is not null").groupBy("tx", "ty").agg(F.min("target").alias("target"))
    whole = t.agg(F.min("tx"), F.min("ty"), F.max("tx"), F.max("ty"), F.count(F.lit(1))).first()
    west, south, east, north, n = whole
    kept = points.filter("x is not null and y is not null").select("point", "x", "y")
    if not n:
        return kept.join(t.select("target"), F.lit(False)).select("point", "target", F.lit(0.0).alias("distance"))
    levels = levels or max(1, math.ceil(math.log(n, 16)) + 1)
    side = (max(east - west, north - south) or 1.0) * 1.000001
    at = lambda c, low, k: F.floor((F.col(c) - low) / (side / 4**k))
    for k in range(1, levels + 1):
        box = t.groupBy(at("tx", west, k).alias("i"), at("ty", south, k).alias("j")).agg(F.min("tx").alias("w"), F.min("ty").alias("s"), F.max("tx").alias("e"), F.max("ty").alias("n"))
        box = box.withColumns({"pi": F.floor(F.col("i") / 4), "pj": F.floor(F.col("j") / 4)})
        # 16^k squares at most: below that size a level may be sent to all
        box = F.broadcast(box) if k <= 3 else box
        met = kept.join(box) if k == 1 else kept.join(box, (F.col("ci") == F.col("pi")) & (F.col("cj") == F.col("pj")))
        out = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
        over = lambda c, lo, hi: F.greatest(F.abs(F.col(lo) - F.col(c)), F.abs(F.col(hi) - F.col(c)))
        met = met.withColumns({"low": F.hypot(out("x", "w", "e"), out("y", "s", "n")), "high": F.hypot(over("x", "w", "e"), over("y", "s", "n"))})
        best = F.min("high").over(Window.partitionBy("point", "x", "y"))
        kept = met.withColumn("best", best).filter(F.col("low") <= F.col("best") * (1 + 1e-12)).select("point", "x", "y", F.col("i").alias("ci"), F.col("j").alias("cj"))
    ends_ = t.withColumns({"ci": at("tx", west, levels), "cj": at("ty", south, levels)})
    far = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    return kept.join(ends_, ["ci", "cj"]).groupBy("point").agg(F.min(F.struct(far.alias("distance"), "target")).alias("b")).select("point", "b.target", "b.distance")


def median_of(column: str, predicate: Column | None = None) -> Column:
    """Exact unweighted median, of the rows where a predicate holds; interpolated."""
    return F.median(F.when(predicate, F.col(column)) if predicate is not None else F.col(column))


def combine_se(df: DataFrame, keys: Sequence[str], se: str = "se") -> DataFrame:
    """Standard error of a sum of independent estimates; a missing one adds nothing."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(F.coalesce(F.col(se), F.lit(0.0)) * F.coalesce(F.col(se), F.lit(0.0)))).alias("se"))


def gvf_ratio(df: DataFrame, a: float, b: float, classes: Sequence[float]) -> DataFrame:
    """(size, cells, ratio): median of cv over the model's 100 a x^b, by classes of total (their lower bounds)."""
    size = F.lit(None).cast("double")
    for low in classes:
        size = F.when(F.col("total") >= low, F.lit(float(low))).otherwise(size)
    rows = df.filter("total > 0 and cv is not null").select(size.alias("size"), (F.col("cv") / (100 * a * F.pow("total", F.lit(b)))).alias("r")).filter("size is not null")
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("cells"), F.median("r").alias("ratio"))


def latest_name(names: DataFrame, key: str = "code") -> DataFrame:
    """(code, name, in_force): the name of least priority number that is not missing; in_force if any row says so."""
    name = F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.col("priority")))
    return names.groupBy(key).agg(name.alias("name"), F.bool_or("current").alias("in_force"))


def subgroup_balance(profile: DataFrame, dimension: str, category: str) -> DataFrame:
    """(unit, inflow, outflow, balance) of one class of a long profile with a direction; the balance only where both are shown."""
    at = (F.col("dimension") == dimension) & (F.col("category") == category)
    side = lambda way: F.max(F.when(F.col("direction") == way, F.col("total")))
    rows = profile.filter(at).groupBy("unit").agg(side("in").alias("inflow"), side("out").alias("outflow"))
    return rows.withColumn("balance", F.col("inflow") - F.col("outflow"))


def regroup(df: DataFrame, keys: Sequence[str], mapping: Mapping[str, Sequence[str]], default: str) -> DataFrame:
    """Published categories summed to coarser ones; those not listed, and nulls, go to ``default``."""
    rows = df.withColumn("category", F.coalesce(recode("category", mapping), F.lit(default)))
    return rows.groupBy(*keys, "category").agg(F.sum("total").alias("total"))


def pyramid(profile: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """(keys, band, men, women, pct_men, pct_women, pct_other): shares of the whole mass, unknown sex and residual included.

    Categories are <band>_m, <band>_f, <band>_i or the residual, in any case. Every band has a row.
    """
    low = profile.withColumn("category", F.lower("category")).groupBy(*keys, "category").agg(F.sum("total").alias("total"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("category") == name, F.col("total"))), F.lit(0.0))
    cells = [F.struct(F.lit(b).alias("band"), of(f"{b}_m").alias("men"), of(f"{b}_f").alias("women")) for b in bands]
    other = F.coalesce(F.sum(F.when(F.col("category").isin("other", *(f"{b}_i" for b in bands)), F.col("total"))), F.lit(0.0))
    rows = low.groupBy(*keys).agg(F.array(*cells).alias("cells"), other.alias("other"))
    whole = F.aggregate("cells", F.col("other"), lambda a, c: a + c["men"] + c["women"])
    share = lambda c: F.when(F.col("whole") > 0, 100 * c / F.col("whole")).otherwise(0.0)
    rows = rows.withColumn("whole", whole).select(*keys, F.explode("cells").alias("c"), "other", "whole")
    return rows.select(*keys, "c.band", "c.men", "c.women", share(F.col("c.men")).alias("pct_men"), share(F.col("c.women")).alias("pct_women"), share(F.col("other")).alias("pct_other"))


def arg_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order that should end in a unique key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def pair_universe(flows: DataFrame, n: int = 20) -> DataFrame:
    """(o, d): pairs among the n largest of either end in any edition; flows have an edition. Ties by partner's code."""
    tagged = flows.select(F.concat_ws("|", "edition", "o").alias("o"), F.concat_ws("|", "edition", "d").alias("d"), "total")
    top = top_partners(tagged, n)
    pairs = top.select(F.when(F.col("direction") == "out", F.col("unit")).otherwise(F.col("partner")).alias("o"), F.when(F.col("direction") == "out", F.col("partner")).otherwise(F.col("unit")).alias("d"))
    return pairs.select(*(F.substring_index(c, "|", -1).alias(c) for c in ("o", "d"))).distinct()


def order_by_recent_rank(ranks: DataFrame, editions: Sequence[str], key: str = "unit") -> DataFrame:
    """(unit, position): by the rank of the latest edition, then of the one before and so on, missing ranks last, then by code."""
    wide = ranks.groupBy(key).agg(*(F.min(F.when(F.col("edition") == e, F.col("place"))).alias(f"e{i}") for i, e in enumerate(editions)))
    order = [F.asc_nulls_last(f"e{i}") for i in reversed(range(len(editions)))]
    return numbered(wide, [*order, F.col(key)]).select(key, "position")


def extremes(df: DataFrame, column: str, k: int, key: str = "unit") -> DataFrame:
    """The k first and the k last rows of a ranking, with side; nulls are not ranked."""
    known = df.filter(F.col(column).isNotNull())
    head, tail = known.orderBy(F.desc(column), key).limit(k), known.orderBy(F.asc(column), key).limit(k)
    return head.withColumn("side", F.lit("top")).unionByName(tail.withColumn("side", F.lit("bottom")))


def ranked(df: DataFrame, column: str, base: str, least: float, k: int, key: str = "unit") -> DataFrame:
    """The k first rows among those with a base of at least ``least``."""
    return df.filter((F.col(base) >= least) & F.col(column).isNotNull()).orderBy(F.desc(column), key).limit(k)


def alluvial(paths: DataFrame, stages: Sequence[str], k: int, kind: str = "class", other: str = "other") -> DataFrame:
    """(stage, source, target, class, total): links of the k largest paths and of one synthetic path that holds the rest.

    The first step has the class ``residence``; later ones the path's own, ``other`` for the rest. Ties by the stages' codes.
    """
    top = paths.orderBy(F.desc("total"), *stages).limit(k).select(*stages, kind, "total")
    keep = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*stages, kind)]
    held = top.select(*(F.col(c).alias(f"_{c}") for c in (*stages, kind)))
    rest = paths.join(held, keep, "left_anti").agg(F.sum("total").alias("total")).filter("total is not null")
    rows = top.unionByName(rest.select(*(F.lit(other).alias(c) for c in (*stages, kind)), "total"))
    links = [F.struct(F.lit(i).alias("stage"), F.col(a).alias("source"), F.col(b).alias("target"), (F.lit("residence") if i == 0 else F.col(kind)).alias("class")) for i, (a, b) in enumerate(zip(stages, stages[1:]))]
    return rows.select(F.explode(F.array(*links)).alias("x"), "total").groupBy("x.stage", "x.source", "x.target", "x.class").agg(F.sum("total").alias("total"))


def symmetric_breaks(df: DataFrame, column: str, shares: Sequence[float] = (0.60, 0.85, 0.96)) -> DataFrame:
    """One row b1, b2, ...: the value of |x| at place floor(p n) of the positive ones in rising order, from 0; 1, 2, 3 without any."""
    sizes = df.select(F.abs(F.col(column)).alias("v")).filter("v > 0")
    place = lambda p, n: min(n - 1, math.floor(p * n))
    n, found = values_at(sizes, "v", lambda n: [place(p, n) for p in shares])
    breaks = [float(found.get(place(p, n), i + 1)) for i, p in enumerate(shares)]
    return df.sparkSession.createDataFrame([breaks], ", ".join(f"b{i + 1} double" for i in range(len(breaks))))


def quantile_filter(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or above the value at place floor(q (n - 1)) in rising order; q = 0 keeps all that have a value."""
    _, found = values_at(df, column, lambda n: [math.floor(q * (n - 1))])
    return df.filter(F.col(column) >= F.lit(min(found.values()))) if found else df.filter(F.lit(False))


def turnover(units: DataFrame) -> DataFrame:
    """turnover I + E and its rate per 1,000 of pop5."""
    total = F.col("inflow") + F.col("outflow")
    return units.withColumns({"turnover": total, "turnover_rate": F.when(F.col("pop5") > 0, 1000 * total / F.col("pop5"))})


def flow_reach(distances: DataFrame) -> DataFrame:
    """(unit, mean_km, median_km) of flows with km: each pair counts at both ends; the row of unit null is the whole country's."""
    both = ends(distances.select("o", "d", "total", "km")).withColumn("w", F.col("inflow") + F.col("outflow")).select("unit", "km", "w")
    whole = distances.select(F.lit(None).cast("string").alias("unit"), "km", F.col("total").alias("w"))
    rows = both.unionByName(whole).filter("w > 0").withColumn("unit", F.coalesce("unit", F.lit("")))
    mean = rows.groupBy("unit").agg((F.sum(F.col("w") * F.col("km")) / F.sum("w")).alias("mean_km"))
    out = mean.join(weighted_median(rows, ["unit"], "km", "w").withColumnRenamed("median", "median_km"), "unit")
    return out.withColumn("unit", F.when(F.col("unit") != "", F.col("unit")))


def national_cross(flows: DataFrame, dim: DataFrame, level: str) -> DataFrame:
    """One row: fraction of all moves that cross the coarser border."""
    both = attach_ends(flows.select("o", "d", "total"), dim, [level])
    crossed = F.sum(F.when(F.col(f"o_{level}") != F.col(f"d_{level}"), F.col("total")))
    return both.agg(F.when(F.sum("total") > 0, F.coalesce(crossed, F.lit(0.0)) / F.sum("total")).alias("share"))


def smi(rates: DataFrame, standard: DataFrame, band: str = "band") -> DataFrame:
    """Age-standardised intensity in percent: rates (edition, band, rate) weighted by a standard population (band, pop), common bands only; null over 0."""
    rows = rates.join(standard.select(band, F.col("pop").alias("_pop")), band).groupBy("edition")
    return rows.agg(F.when(F.sum("_pop") > 0, 100 * F.sum(F.col("rate") * F.col("_pop")) / F.sum("_pop")).alias("smi"))


def fielding_slope(units: DataFrame, y: str, density: str, pop: str) -> DataFrame:
    """(n, slope, se): population-weighted regression of a net rate on log10 density, null below three units.

    Sums of the first pass give the line; a second pass its squared residuals, which near-exact fits need.
    """
    known = units.filter(f"{y} is not null and {density} > 0 and {pop} > 0").select(F.log10(density).alias("x"), F.col(y).alias("y"), F.col(pop).alias("w"))
    c = F.col
    s = known.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), (F.sum(c("w") * c("x")) / F.sum("w")).alias("mx"), (F.sum(c("w") * c("y")) / F.sum("w")).alias("my"))
    centred = known.join(F.broadcast(s)).select("w", "n", (c("x") - c("mx")).alias("x"), (c("y") - c("my")).alias("y"))
    t = centred.agg(F.max("n").alias("n"), F.sum(c("w") * c("x") * c("x")).alias("sxx"), F.sum(c("w") * c("x") * c("y")).alias("sxy"))
    line = t.select("n", "sxx", F.when((c("n") >= 3) & (c("sxx") > 0), c("sxy") / c("sxx")).alias("slope"))
    left = centred.select("w", "x", "y").join(F.broadcast(line)).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("sxx").alias("sxx"), F.sum(c("w") * (c("y") - c("slope") * c("x")) * (c("y") - c("slope") * c("x"))).alias("ss"))
    return left.select("n", "slope", F.when(c("n") >= 3, F.sqrt(c("ss") / (c("n") - 2) / c("sxx"))).alias("se"))


def intensity_by_scale(system: DataFrame) -> DataFrame:
    """(edition, level, units, log_units, cmi): intensity against the number of units of each level."""
    return system.select("edition", "level", "units", F.log(F.col("units").cast("double")).alias("log_units"), "cmi")


def selectivity_or(df: DataFrame, trait: Column, mover: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Odds ratio of a trait, movers against the others, from weights; rows of unknown trait are left out; null if a cell is empty."""
    w = lambda p: F.coalesce(F.sum(F.when(p, F.col("weight"))), F.lit(0.0))
    rows = df.filter(trait.isNotNull() & mover.isNotNull()).groupBy(*keys).agg(w(mover & trait).alias("a"), w(mover & ~trait).alias("b"), w(~mover & trait).alias("c"), w(~mover & ~trait).alias("d"))
    return rows.select(*keys, F.when((F.col("b") > 0) & (F.col("c") > 0), F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).alias("odds_ratio"))


def age_sex_summary(df: DataFrame, bands: Sequence[tuple[str, float, float]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, sex_ratio, median_age, peak_band) of weighted persons (age_band, sex 1 men and 2 women).

    The median is interpolated in the band in which half of the weight is reached; the peak is the band of most weight, the
    younger of ties. bands: (label, low, high).
    """
    table = F.create_map(*[x for i, (label, low, high) in enumerate(bands) for x in (F.lit(label), F.struct(F.lit(i).alias("i"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")))])
    base = df.withColumn("_b", table[F.col("age_band")])
    sex = lambda s: F.sum(F.when(F.col("sex") == s, F.col("weight")))
    ratio = df.groupBy(*keys).agg(F.when(sex(2) > 0, 100 * sex(1) / sex(2)).alias("sex_ratio"))
    mass = base.filter("_b is not null").groupBy(*keys, "age_band", "_b").agg(F.sum("weight").alias("m"))
    by = Window.partitionBy(*keys)
    run = F.sum("m").over(by.orderBy("_b.i").rowsBetween(Window.unboundedPreceding, 0))
    rows = mass.withColumn("run", run).withColumn("whole", F.sum("m").over(by))
    at = F.col("_b.low") + (F.col("_b.high") - F.col("_b.low")) * (0.5 * F.col("whole") - (F.col("run") - F.col("m"))) / F.col("m")
    half = (F.col("run") >= 0.5 * F.col("whole")) & (F.col("run") - F.col("m") < 0.5 * F.col("whole"))
    found = rows.groupBy(*keys).agg(F.max(F.when(half, at)).alias("median_age"), F.max_by("age_band", F.struct("m", -F.col("_b.i"))).alias("peak_band"))
    return ratio.join(found, list(keys)) if keys else ratio.join(F.broadcast(found))


def national_summary(units: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: movers, unknown origins, from abroad, pop5, pairs, units."""
    u = units.agg(F.sum("inflow").alias("movers"), F.sum("unknown_origin").alias("unknown_origin"), F.sum("international").alias("international"), F.sum("pop5").alias("pop5"), F.count(F.lit(1)).alias("units"))
    return u.join(F.broadcast(flows.agg(F.count(F.lit(1)).alias("pairs"))))

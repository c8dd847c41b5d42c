"""Origin-destination flows and what is read off them. A flow table has o, d, total; it is never made dense."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.recode import flag
from odflow.operators.estimate import cell_variance, se_cv
from odflow.sources.store import cut


def flag_flow(persons: DataFrame, sentinels: Sequence[str] = ("99",)) -> DataFrame:
    """is_flow: came from another known unit of the country."""
    moved = (F.col("prev_local") == "2") & ~F.col("prev_unit").isin(*sentinels) & (F.col("prev_unit") != F.col("unit"))
    return persons.withColumn("is_flow", flag(moved))


def attach_ends(df: DataFrame, dim: DataFrame, columns: Sequence[str], o: str = "o", d: str = "d") -> DataFrame:
    """Columns of the unit table for both ends, as o_<c> and d_<c>."""
    out = df
    for end in (o, d):
        side = dim.select(F.col("unit").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = out.join(side, end, "left")
    return out


def flow_matrix(persons: DataFrame, frame: DataFrame, o: str = "prev_unit", d: str = "unit") -> DataFrame:
    """o, d, total, n, n_psu, variance, se, cv of the flagged persons."""
    rows = persons.filter("is_flow").select(F.col(o).alias("o"), F.col(d).alias("d"), "stratum", "psu", "weight")
    return se_cv(cell_variance(rows, ["o", "d"], frame))


def rollup_flows(persons: DataFrame, dim: DataFrame, level: str, frame: DataFrame) -> DataFrame:
    """Flows between the groups of a level: moves inside a group dissolve, the variance is worked out anew."""
    rows = persons.filter("is_flow").select(F.col("prev_unit").alias("o"), F.col("unit").alias("d"), "stratum", "psu", "weight")
    ends = attach_ends(rows, dim, [level]).select(F.col(f"o_{level}").alias("o"), F.col(f"d_{level}").alias("d"), "stratum", "psu", "weight")
    return se_cv(cell_variance(ends.filter("o <> d"), ["o", "d"], frame))


def ends(flows: DataFrame) -> DataFrame:
    """(unit, partner, inflow, outflow): each flow once at either end."""
    both = F.explode(F.array(
        F.struct(F.col("d").alias("unit"), F.col("o").alias("partner"), F.col("total").alias("inflow"), F.lit(0.0).alias("outflow")),
        F.struct(F.col("o").alias("unit"), F.col("d").alias("partner"), F.lit(0.0).alias("inflow"), F.col("total").alias("outflow")),
    )).alias("e")
    return flows.select(both, *(c for c in flows.columns if c not in ("o", "d", "total"))).select("e.*", *(c for c in flows.columns if c not in ("o", "d", "total")))


def level_indicators(flows: DataFrame) -> DataFrame:
    """inflow, outflow, net, turnover, effectiveness of each end."""
    sums = ends(flows).groupBy("unit").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    total = F.col("inflow") + F.col("outflow")
    return sums.withColumns({"net": F.col("inflow") - F.col("outflow"), "turnover": total, "effectiveness": F.when(total > 0, (F.col("inflow") - F.col("outflow")) / total)})


def unit_indicators(persons: DataFrame, dim: DataFrame, frame: DataFrame, min_age: int = 5) -> DataFrame:
    """A row for every unit of ``dim``: weights, counts, rates per 1,000 of pop5, effectiveness, and errors of both ends.

    pop, pop5, inflow, unknown_origin, international, outflow, net; n_in, n_out, n_unknown, n_international; psu_in, psu_out;
    in_rate, out_rate, net_rate, effectiveness; se_in, se_out, se_net (ends taken as independent), cv_in, cv_out in percent.
    Everyone is summed by unit before anything is shuffled; only movers are grouped by household, once for either end.
    """
    w = F.col("weight")
    part = lambda p: F.coalesce(F.sum(F.when(p, w)), F.lit(0.0))
    unknown, abroad = (F.col("prev_local") == "2") & ~F.col("is_flow"), F.col("prev_local") == "3"
    here = persons.groupBy("unit").agg(
        F.sum(w).alias("pop"), part(F.col("age") >= min_age).alias("pop5"), part(unknown).alias("unknown_origin"), part(abroad).alias("international"),
        F.count(F.when(unknown, 1)).alias("n_unknown"), F.count(F.when(abroad, 1)).alias("n_international"),
    )
    end = F.explode(F.array(F.struct(F.lit("in").alias("way"), F.col("unit")), F.struct(F.lit("out").alias("way"), F.col("prev_unit").alias("unit")))).alias("x")
    moved = persons.filter("is_flow").select("stratum", "psu", "weight", end).select("stratum", "psu", "weight", "x.*")
    both = se_cv(cell_variance(moved, ["unit", "way"], frame))
    at = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    ends_ = both.groupBy("unit").agg(*(at(way, c).alias(f"{n}_{way}") for way in ("in", "out") for c, n in (("total", "t"), ("n", "n"), ("n_psu", "psu"), ("se", "se"), ("cv", "cv"))))
    counts = ("n_in", "n_out", "n_unknown", "n_international", "psu_in", "psu_out")
    weights = ("pop", "pop5", "unknown_origin", "international", "t_in", "t_out", "se_in", "se_out")
    rows = dim.select("unit").join(here, "unit", "left").join(ends_, "unit", "left").fillna(0, [*counts, *weights])
    i, o = F.col("t_in"), F.col("t_out")
    rate = lambda x: F.when(F.col("pop5") > 0, 1000 * x / F.col("pop5"))
    return rows.select(
        "unit", "pop", "pop5", "unknown_origin", "international", i.alias("inflow"), o.alias("outflow"), (i - o).alias("net"), *counts,
        rate(i).alias("in_rate"), rate(o).alias("out_rate"), rate(i - o).alias("net_rate"), F.when(i + o > 0, (i - o) / (i + o)).alias("effectiveness"),
        "se_in", "se_out", F.sqrt(F.col("se_in") * F.col("se_in") + F.col("se_out") * F.col("se_out")).alias("se_net"), "cv_in", "cv_out",
    )


def with_reverse(flows: DataFrame) -> DataFrame:
    """total of a pair beside the reverse one's; pairs with one direction only have 0 for the other."""
    back = flows.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("total").alias("reverse"))
    pairs = flows.select("o", "d", "total").join(back, ["o", "d"], "full")
    return pairs.select("o", "d", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("reverse", F.lit(0.0)).alias("reverse"))


def outer_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("o", "d", F.col("total").alias("a")), b.select("o", "d", F.col("total").alias("b"))
    return x.join(y, ["o", "d"], "full").select("o", "d", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def both_in(flows: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select(F.col("unit")).distinct()
    return flows.join(m.withColumnRenamed("unit", "o"), "o", "left_semi").join(m.withColumnRenamed("unit", "d"), "d", "left_semi").select(*flows.columns)


def exactly_one_in(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Flows that cross the border of a set of units."""
    m = members.select("unit").distinct()
    marked = flows
    for end in ("o", "d"):
        marked = marked.join(m.select(F.col("unit").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
    return marked.filter(F.col("in_o").isNull() != F.col("in_d").isNull()).select(*flows.columns)


def same_group_pairs(flows: DataFrame, dim: DataFrame, group: str) -> DataFrame:
    """Flows with both ends in one group, with the group."""
    both = attach_ends(flows, dim, [group])
    return both.filter(F.col(f"o_{group}") == F.col(f"d_{group}")).select(F.col(f"o_{group}").alias(group), *flows.columns)


def external_exchange(flows: DataFrame, dim: DataFrame, group: str) -> DataFrame:
    """(group, inflow, outflow) with partners outside of the group, partners without a group included."""
    both = attach_ends(flows, dim, [group]).filter(~F.col(f"o_{group}").eqNullSafe(F.col(f"d_{group}")))
    rows = both.select(F.explode(F.array(
        F.struct(F.col(f"d_{group}").alias(group), F.col("total").alias("inflow"), F.lit(0.0).alias("outflow")),
        F.struct(F.col(f"o_{group}").alias(group), F.lit(0.0).alias("inflow"), F.col("total").alias("outflow")),
    )).alias("e")).select("e.*").filter(F.col(group).isNotNull())
    return rows.groupBy(group).agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))


def top_partners(flows: DataFrame, n: int) -> DataFrame:
    """The n largest partners of each unit in either direction; ties by partner's code."""
    out = flows.select(F.col("o").alias("unit"), F.lit("out").alias("direction"), F.col("d").alias("partner"), "total")
    into = flows.select(F.col("d").alias("unit"), F.lit("in").alias("direction"), F.col("o").alias("partner"), "total")
    rank = F.row_number().over(Window.partitionBy("unit", "direction").orderBy(F.desc("total"), "partner"))
    return out.unionByName(into).withColumn("place", rank).filter(F.col("place") <= n)


def partner_rank(flows: DataFrame, fixed: str) -> DataFrame:
    """place: rank of the partner among those of the fixed end; null totals have none."""
    w = Window.partitionBy(fixed).orderBy(F.desc_nulls_last("total"))
    return flows.withColumn("place", F.when(F.col("total").isNotNull(), F.rank().over(w)))


def top_flows(flows: DataFrame, k: int, by: str = "total") -> DataFrame:
    return flows.orderBy(F.desc(by), "o", "d").limit(k)


def connectivity(flows: DataFrame, distinct_partners: bool = False) -> DataFrame:
    """Pairs with a positive flow at each unit: directed, or distinct partners."""
    e = ends(flows.filter("total > 0").select("o", "d", "total"))
    e = e.select("unit", "partner").distinct() if distinct_partners else e
    return e.groupBy("unit").agg(F.count(F.lit(1)).alias("pairs"))


def weighted_median(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """First value at which the running weight reaches half; no interpolation. Equal values are summed before the window."""
    grouped = df.groupBy(*keys, x).agg(F.sum(w).alias("w"))
    by = Window.partitionBy(*keys)
    run = F.sum("w").over(by.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return grouped.select(*keys, x, run.alias("run"), F.sum("w").over(by).alias("all")).filter("run >= 0.5 * all").groupBy(*keys).agg(F.min(x).alias("median"))


def partner_gini(flows: DataFrame, end: str) -> DataFrame:
    """Gini index of the partners' volumes of each unit at an end: sum((2 i - n - 1) x_i) / (n sum x); null without volume."""
    w = Window.partitionBy(end).orderBy("total", "o", "d")
    x = flows.select(F.col(end).alias("unit"), "total", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(end)).alias("n"))
    return x.groupBy("unit").agg(F.when(F.sum("total") > 0, F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("total")) / (F.max("n") * F.sum("total"))).alias("gini"))


def pct_cross(flows: DataFrame, dim: DataFrame, level: str) -> DataFrame:
    """Fraction of each unit's exchange that crosses the coarser border; null without exchange."""
    both = attach_ends(flows.select("o", "d", "total"), dim, [level])
    e = ends(both.select("o", "d", "total", (F.col(f"o_{level}") != F.col(f"d_{level}")).alias("cross")))
    v = F.col("inflow") + F.col("outflow")
    return e.groupBy("unit").agg(F.when(F.sum(v) > 0, F.coalesce(F.sum(F.when(F.col("cross"), v)), F.lit(0.0)) / F.sum(v)).alias("share"))


def distance_km(points: DataFrame, flows: DataFrame) -> DataFrame:
    """flows with km between the ends' planar points (x, y in metres)."""
    both = attach_ends(flows, points, ["x", "y"])
    return both.withColumn("km", F.hypot(F.col("o_x") - F.col("d_x"), F.col("o_y") - F.col("d_y")) / 1000.0).select(*flows.columns, "km")


def dissimilarity(a: DataFrame, b: DataFrame, support: str = "union") -> DataFrame:
    """Half the sum of |p - q| of two flow structures, null if one is empty or sums to 0; support: union or common pairs."""
    pairs = outer_pairs(a, b)
    if support == "common":
        pairs = pairs.filter("a > 0 and b > 0")
    whole = pairs.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return pairs.join(F.broadcast(whole)).agg((0.5 * F.sum(F.abs(F.try_divide("a", "sa") - F.try_divide("b", "sb")))).alias("dissimilarity"))


def system_measures(flows: DataFrame, population: float | Column) -> DataFrame:
    """One row: moves, crude intensity 100 M / P, effectiveness 100 / 2 sum|net| / M, aggregate net rate; null over 0."""
    pop = population if isinstance(population, Column) else F.lit(float(population))
    s = level_indicators(flows).agg(F.sum("inflow").alias("moves"), F.sum(F.abs("net")).alias("spread"))
    return s.select("moves", F.try_divide(100 * F.col("moves"), pop).alias("cmi"), F.try_divide(50 * F.col("spread"), "moves").alias("mei"), F.try_divide(50 * F.col("spread"), pop).alias("anmr"))


def weighted_slope(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted least-squares slope and intercept from sums; null with fewer than three points, or if all have one x."""
    s = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(x)).alias("sx"), F.sum(F.col(w) * F.col(y)).alias("sy"),
        F.sum(F.col(w) * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(w) * F.col(x) * F.col(y)).alias("sxy"),
    )
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select("n", F.when(F.col("n") >= 3, slope).alias("slope")).join(F.broadcast(s.select("sw", "sx", "sy"))).select("n", "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), "sw").alias("intercept"))


def multiplicative_components(flows: DataFrame) -> DataFrame:
    """total, share of the row, share of the column, and observed over expected of each pair ("total" coding); null over 0."""
    rows, cols = flows.groupBy("o").agg(F.sum("total").alias("ro")), flows.groupBy("d").agg(F.sum("total").alias("cd"))
    whole = flows.agg(F.sum("total").alias("t"))
    j = flows.select("o", "d", "total").join(rows, "o").join(cols, "d").join(F.broadcast(whole))
    return j.select("o", "d", "total", F.try_divide("ro", "t").alias("o_share"), F.try_divide("cd", "t").alias("d_share"), F.try_divide(F.col("total") * F.col("t"), F.col("ro") * F.col("cd")).alias("od_ratio"))


def ipf(seed: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int = 50, tolerance: float = 1e-9, cut_every: int = 5) -> DataFrame:
    """The fitted cells of ``fit_margins``."""
    return _fitted(seed, rows, cols, rounds, tolerance, cut_every)[0]


def fit_margins(seed: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int = 50, tolerance: float = 1e-9, cut_every: int = 5) -> tuple[DataFrame, DataFrame]:
    """(cells, status): a seed (o, d, total) fitted to margins rows (o, target) and cols (d, target); zero cells stay zero.

    cells: o, d, total. Cells of which an end has no target are left out; a target of 0 makes its cells 0.
    status, one row: converged, rounds, error (largest miss of a margin, relative to it; absolute where it is 0), unreached (ends
    with a positive target and no cell that could carry it), blocks, unbalanced (blocks of the seed, joined by cells of positive
    targets, whose two margins sum to different totals: no fit can reach both). With either above 0 the fit cannot converge.
    """
    cells, status = _fitted(seed, rows, cols, rounds, tolerance, cut_every)
    return cells, status()


def _fitted(seed: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int, tolerance: float, cut_every: int) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The cells of ``fit_margins``, and what works out the status.

    The seed stays as it is, and a factor for each end is fitted in turn: a round is two joins with a vector and two aggregates. After
    a round the columns fit, so what the rows miss tells how far it is; that falls out of the next round's sums. Seed, margins and
    every ``cut_every`` rounds the rows' factors are written, which a lost executor survives, and one number reaches the driver.
    """
    rows, cols = (cut(m.select(c, F.col("target").cast("double").alias("target"))) for m, c in ((rows, "o"), (cols, "d")))
    known = seed.select("o", "d", F.col("total").cast("double").alias("total")).filter("total > 0")
    x = cut(known.join(rows.select("o"), "o", "left_semi").join(cols.select("d"), "d", "left_semi").select("o", "d", "total"))

    def sums(vector: DataFrame, by: str, end: str, target: DataFrame) -> DataFrame:
        """The target's ends with m, what their cells sum to with the other side's factors."""
        found = x.join(vector, by).groupBy(end).agg(F.sum(F.col("total") * F.col("f")).alias("m"))
        return target.join(found, end, "left").fillna(0.0, ["m"])

    factor = F.when(F.col("m") > 0, F.col("target") / F.col("m")).otherwise(0.0).alias("f")
    missed = lambda value: F.when(F.col("target") != 0, F.abs(value / F.col("target") - 1)).otherwise(F.abs(value))
    fit = lambda r: sums(r, "o", "d", cols).select("d", factor)
    state = sums(cols.select("d", F.lit(1.0).alias("f")), "d", "o", rows).select("o", factor)
    done, worst, r = 0, None, state
    while done < rounds:
        for _ in range(min(cut_every, rounds - done)):
            r, done = state, done + 1
            state = sums(fit(r), "d", "o", rows).select("o", "target", "m", factor)
        held = cut(state.join(r.select("o", F.col("f").alias("r")), "o").select("o", "f", F.col("r"), missed(F.col("r") * F.col("m")).alias("miss")))
        r, state = held.select("o", F.col("r").alias("f")), held.select("o", "f")
        worst = held.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    c = fit(r)
    cells = x.join(r.withColumnRenamed("f", "r"), "o").join(c, "d").select("o", "d", (F.col("total") * F.col("r") * F.col("f")).alias("total"))
    # columns fit after every round, but those that no cell reaches
    lost = sums(r, "o", "d", cols).agg(F.max(F.when((F.col("m") == 0) & (F.col("target") != 0), 1.0).otherwise(0.0)).alias("lost"))
    live = x.join(rows.filter("target > 0").select("o"), "o", "left_semi").join(cols.filter("target > 0").select("d"), "d", "left_semi").select("o", "d", "total")
    return cells, lambda: _fit_status(live, rows, cols, tolerance, done, worst, lost)


def _fit_status(live: DataFrame, rows: DataFrame, cols: DataFrame, tolerance: float, done: int, worst: float | None, lost: DataFrame) -> DataFrame:
    """The status row of ``fit_margins``; live: cells whose ends have positive targets."""
    ends_ = rows.filter("target > 0").select(F.lit("o").alias("side"), F.col("o").alias("key"), "target").unionByName(cols.filter("target > 0").select(F.lit("d").alias("side"), F.col("d").alias("key"), "target"))
    met = live.select(F.explode(F.array(F.struct(F.lit("o").alias("side"), F.col("o").alias("key")), F.struct(F.lit("d").alias("side"), F.col("d").alias("key")))).alias("e")).select("e.*").distinct()
    unreached = ends_.join(met, ["side", "key"], "left_anti").agg(F.count(F.lit(1)).alias("unreached"))
    sums = seed_blocks(live).join(ends_, ["side", "key"]).groupBy("block").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("target"))), F.lit(0.0)).alias(s) for s in ("o", "d")))
    off = F.abs(F.col("o") - F.col("d")) > tolerance * F.greatest("o", "d")
    blocks = sums.agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(off, 1)).alias("unbalanced"))
    error = F.greatest(F.lit(worst).cast("double"), F.coalesce("lost", F.lit(0.0)))
    one = lost.select(F.coalesce(error <= tolerance, F.lit(True)).alias("converged"), F.lit(done).alias("rounds"), error.alias("error"))
    return one.join(F.broadcast(unreached)).join(F.broadcast(blocks))


def seed_blocks(cells: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(side, key, block): the connected parts of a table (o, d), each named by its smallest origin.

    Every end takes the least name among its cells, and then the name that its name's own origin has, so names halve their way; each
    round is written and its changes are counted. ``most_rounds`` is a guard that raises, never a cut.
    """
    pairs = cut(cells.select("o", "d").distinct())
    o = cut(pairs.select("o").distinct().select("o", F.col("o").alias("block")))
    for _ in range(most_rounds):
        d = pairs.join(o, "o").groupBy("d").agg(F.min("block").alias("block"))
        near = pairs.join(d, "d").groupBy("o").agg(F.min("block").alias("near"))
        jump = o.select(F.col("o").alias("near"), F.col("block").alias("far"))
        new = cut(o.join(near, "o").join(jump, "near").select("o", F.col("block").alias("old"), F.least("near", "far").alias("block")))
        changed = new.filter("block <> old").limit(1).count()
        o = new.select("o", "block")
        if not changed:
            d = pairs.join(o, "o").groupBy("d").agg(F.min("block").alias("block"))
            return o.select(F.lit("o").alias("side"), F.col("o").alias("key"), "block").unionByName(d.select(F.lit("d").alias("side"), F.col("d").alias("key"), "block"))
    raise ValueError(f"blocks of the table still change after {most_rounds} rounds")

"""Independent checks of what was released, from the microdata and from the tables alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.recode import bands_below, check_digit
from odflow.spec import Limits


def audit_rows(published: DataFrame, micro: DataFrame, keys: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """One row: published cells, those below a floor and those absent from the sample, counted anew from microdata."""
    truth = micro.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true"), F.countDistinct("psu").alias("psu_true"))
    joined = published.select(*keys).join(truth, list(keys), "left")
    low = F.col("n_true") < limits.persons
    if limits.psus is not None:
        low |= F.col("psu_true") < limits.psus
    return joined.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(low, 1)).alias("below"), F.count(F.when(F.col("n_true").isNull(), 1)).alias("absent"))


def audit_cells(published: DataFrame, micro: DataFrame, keys: Sequence[str], dims: Mapping[str, Sequence[str]], universes: Mapping[str, Column] = {}, least: int = 5) -> DataFrame:
    """(column, shown, below): published category cells, and those with fewer persons than ``least`` in the microdata."""
    names = [(f"{d}__{c}", universes.get(d, F.lit(True)) & (F.col(d) == c)) for d, cs in dims.items() for c in cs]
    truth = micro.groupBy(*keys).agg(*(F.count(F.when(at, 1)).alias(f"_n_{name}") for name, at in names))
    joined = published.select(*keys, *(n for n, _ in names)).join(truth, list(keys), "left")
    low = lambda n: F.col(n).isNotNull() & (F.coalesce(F.col(f"_n_{n}"), F.lit(0)) < least)
    one = joined.agg(*(F.struct(F.lit(n).alias("column"), F.count(n).alias("shown"), F.count(F.when(low(n), 1)).alias("below")).alias(n) for n, _ in names))
    return one.select(F.explode(F.array(*(n for n, _ in names))).alias("x")).select("x.*")


def audit_detail(published: DataFrame, micro: DataFrame, keys: Sequence[str], columns: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """One row: rows that show detail, and those of them with fewer persons than the floor of detail."""
    truth = micro.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true"))
    any_ = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
    shown = published.filter(any_).join(truth, list(keys), "left")
    return shown.agg(F.count(F.lit(1)).alias("shown"), F.count(F.when(F.coalesce("n_true", F.lit(0)) < limits.detail, 1)).alias("below"))


def audit_psu_declared(micro: DataFrame, has_psu: bool) -> DataFrame:
    """One row: persons with a household id, and whether that agrees with what the edition declares."""
    return micro.agg(F.count("psu").alias("with_psu"), ((F.count("psu") > 0) == F.lit(has_psu)).alias("ok"))


def calibrate_threshold(cells: DataFrame, ks: Sequence[int], psus: int = 3) -> DataFrame:
    """(k, cells, rejected, share): of cells with at least k persons, those that the household floor would reject."""
    grid = cells.select("n", "n_psu", F.explode(F.array(*map(F.lit, ks))).alias("k")).filter("n >= k")
    low = F.count(F.when(F.col("n_psu") < psus, 1))
    return grid.groupBy("k").agg(F.count(F.lit(1)).alias("cells"), low.alias("rejected"), (low / F.count(F.lit(1))).alias("share"))


def code_check_digit(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row: codes, and those that are too short or whose last figure is not their check digit."""
    whole = F.col(column).rlike(f"^[0-9]{{{digits + 1}}}$")
    bad = ~whole | (F.substring(column, digits + 1, 1) != F.when(whole, check_digit(column, digits)))
    return df.agg(F.count(column).alias("codes"), F.count(F.when(F.col(column).isNotNull() & bad, 1)).alias("invalid"))


def code_diff(a: DataFrame, b: DataFrame, key: str = "code") -> DataFrame:
    """(code, side): codes that only a has (unexpected) and that only b has (missing)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(key, F.lit("unexpected").alias("side")).unionByName(y.join(x, key, "left_anti").select(key, F.lit("missing").alias("side")))


def reconcile(a: DataFrame, b: DataFrame, groups: Mapping[str, Sequence[str]], weight: str = "weight") -> DataFrame:
    """(check, left, right, ok) of two sources: rows, weights, and for each group of columns the rows that one side lacks.

    Rows are counted with repeats and null equals null. Each side is read once: rows are marked by side, every row gives its values
    in each group, and one aggregation by these counts both sides.
    """
    columns = sorted({c for own in groups.values() for c in own} | {weight})
    side = lambda df, of: df.select(*columns, F.lit(of).alias("_side"))
    whole = [F.struct(F.lit(name).alias("check"), F.lit(None).cast("string").alias("key"), value.alias("value")) for name, value in (("rows", F.lit(1.0)), ("weight", F.coalesce(F.col(weight).cast("double"), F.lit(0.0))))]
    values = lambda own: F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    each = [F.struct(F.lit(name).alias("check"), values(own).alias("key"), F.lit(1.0).alias("value")) for name, own in groups.items()]
    rows = side(a, 0).unionByName(side(b, 1)).select("_side", F.explode(F.array(*whole, *each)).alias("x")).select("_side", "x.*")
    on = lambda of: F.sum(F.when(F.col("_side") == of, F.col("value")).otherwise(0.0))
    counted = rows.groupBy("check", "key").agg(on(0).alias("a"), on(1).alias("b"))
    more = F.col("key").isNotNull()
    excess = lambda x, y: F.sum(F.when(more, F.greatest(F.col(x) - F.col(y), F.lit(0.0))).otherwise(F.col(x)))
    sums = counted.groupBy("check").agg(excess("a", "b").alias("left"), excess("b", "a").alias("right"))
    names = F.explode(F.array(*map(F.lit, ("rows", "weight", *groups)))).alias("check")
    out = a.sparkSession.range(1).select(names).join(sums, "check", "left").fillna(0.0, ["left", "right"])
    exact = F.when(F.col("check").isin("rows", "weight"), F.abs(F.col("left") - F.col("right")) < 1e-6).otherwise((F.col("left") == 0) & (F.col("right") == 0))
    return out.select("check", "left", "right", exact.alias("ok"))


def _checks(df: DataFrame, rows: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(name, value, expected, ok) from one row of aggregates."""
    made = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), e.cast("double").alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, v, e, ok in rows]
    return df.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def check_totals(df: DataFrame, rows: int, weight: float, groups: int, group: str, tolerance: float = 100.0) -> DataFrame:
    """At least ``rows`` rows, the known sum of weights, the known number of groups."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.countDistinct(group).alias("g"))
    c, lit = F.col, F.lit
    return _checks(one, [("rows", c("n"), lit(rows), c("n") >= rows), ("weight", c("w"), lit(weight), F.abs(c("w") - weight) < tolerance), ("groups", c("g"), lit(groups), c("g") == groups)])


def check_group_totals(df: DataFrame, reference: DataFrame, group: str, tolerance: float = 0.3) -> DataFrame:
    """(group, value, expected, ok): weights of each group of the reference (group, expected) within a share of it."""
    sums = df.groupBy(group).agg(F.sum("weight").alias("value"))
    rows = reference.select(group, "expected").join(sums, group, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.select(group, "value", "expected", F.col("value").between((1 - tolerance) * F.col("expected"), (1 + tolerance) * F.col("expected")).alias("ok"))


def check_share(df: DataFrame, predicate: Column, low: float, high: float, name: str = "share") -> DataFrame:
    """Percent of rows where the predicate holds, between bounds; an empty table is null and not ok."""
    one = df.agg(F.try_divide(100 * F.count(F.when(predicate, 1)), F.count(F.lit(1))).alias("v"))
    return _checks(one, [(name, F.col("v"), F.lit(high), F.col("v").between(low, high))])


def check_join_complete(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b has, against all rows of a."""
    keys = b.select(key).distinct().withColumn("_in", F.lit(1))
    one = a.select(key).join(keys, key, "left").agg(F.count("_in").alias("v"), F.count(F.lit(1)).alias("e"))
    return _checks(one, [("join", F.col("v"), F.col("e"), F.col("v") == F.col("e"))])


def check_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """No null in boolean flags."""
    one = df.agg(*(F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in flags))
    return _checks(one, [(f, F.col(f), F.lit(0), F.col(f) == 0) for f in flags])


def check_loops(flows: DataFrame) -> DataFrame:
    """No flow from a unit to itself."""
    one = flows.agg(F.count(F.when(F.col("o").eqNullSafe(F.col("d")), 1)).alias("v"))
    return _checks(one, [("loops", F.col("v"), F.lit(0), F.col("v") == 0)])


def check_metro(members: DataFrame, triples: DataFrame, summary: DataFrame) -> DataFrame:
    """Triples add up to the employed movers of the summary; one core a region; one region a unit at most."""
    cores = members.groupBy("metro").agg(F.count(F.when(F.col("is_core"), 1)).alias("k")).agg(F.count(F.when(F.col("k") != 1, 1)).alias("cores"))
    twice = members.groupBy("unit").agg(F.countDistinct("metro").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("twice"))
    sums = triples.agg(F.sum("total").alias("t")).join(F.broadcast(summary.agg(F.sum("employed").alias("e"))))
    one = sums.join(F.broadcast(cores)).join(F.broadcast(twice))
    c, zero = F.col, F.lit(0)
    return _checks(one, [("triples", c("t"), c("e"), F.abs(c("t") - c("e")) < 1e-6), ("cores", c("cores"), zero, c("cores") == 0), ("regions", c("twice"), zero, c("twice") == 0)])


def check_bounds(series: DataFrame, bounds: Mapping[str, tuple[float, float]], slack: float = 1e-9) -> DataFrame:
    """Values of panel columns outside their bounds; nulls are left out."""
    one = series.agg(*(F.count(F.when(~F.col(c).between(lo - slack, hi + slack), 1)).alias(c) for c, (lo, hi) in bounds.items()))
    return _checks(one, [(c, F.col(c), F.lit(0), F.col(c) == 0) for c in bounds])


def check_geometry(inside: DataFrame, points: DataFrame, most: float = 0.005) -> DataFrame:
    """Share of unit points (point, unit) that lie in no polygon of their own unit (inside: point, unit), against a bound."""
    hit = inside.select("point", "unit").distinct().withColumn("_in", F.lit(1))
    one = points.select("point", "unit").join(hit, ["point", "unit"], "left").agg((1 - F.try_divide(F.count("_in"), F.count(F.lit(1)))).alias("v"))
    return _checks(one, [("points_outside", F.col("v"), F.lit(most), F.col("v") <= most)])


def check_group_boxes(groups: DataFrame, whole: DataFrame, slack: float) -> DataFrame:
    """Boxes (west, south, east, north) of groups that reach out of the whole's by more than ``slack``."""
    j = groups.join(F.broadcast(whole.select(*(F.col(c).alias(f"w_{c}") for c in ("west", "south", "east", "north")))))
    out = (F.col("west") < F.col("w_west") - slack) | (F.col("south") < F.col("w_south") - slack) | (F.col("east") > F.col("w_east") + slack) | (F.col("north") > F.col("w_north") + slack)
    return _checks(j.agg(F.count(F.when(out, 1)).alias("v")), [("boxes", F.col("v"), F.lit(0), F.col("v") == 0)])


def audit_structure(table: DataFrame, banned: Sequence[str] = ("n", "n_psu", "psu"), base: int = 5, bands_forbidden: Sequence[str] = tuple(bands_below(5))) -> DataFrame:
    """One row: banned columns, totals off the base, forbidden bands."""
    off = F.count(F.when(F.col("total") % base != 0, 1))
    bad = F.count(F.when(F.col("n_band").isin(*bands_forbidden), 1)) if bands_forbidden and "n_band" in table.columns else F.lit(0).cast("long")
    return table.agg(F.lit(sum(c in banned for c in table.columns)).cast("long").alias("banned_columns"), off.alias("off_base"), bad.alias("bad_bands"))


def scan_codes(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(column, hits): how often one of the codes stands in each string column."""
    names = [n for n, t in df.dtypes if t == "string"]
    one = df.agg(*(F.count(F.when(F.col(n).isin(*codes), 1)).alias(n) for n in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).alias("hits")) for n in names))).alias("x")).select("x.*")


def orphans(df: DataFrame, dim: DataFrame, key: str, dim_key: str = "unit") -> DataFrame:
    """(code, rows) of codes that the dimension lacks."""
    codes = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    return codes.join(dim.select(F.col(dim_key).alias("code")), "code", "left_anti")


def multiset_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(only_a, only_b): rows, counted with repeats, of either side that the other lacks; null equals null."""
    x, y = a.select(*columns), b.select(*columns)
    left, right = x.exceptAll(y).agg(F.count(F.lit(1)).alias("only_a")), y.exceptAll(x).agg(F.count(F.lit(1)).alias("only_b"))
    return left.join(F.broadcast(right))


def check_profile(profile: DataFrame, flows: DataFrame) -> DataFrame:
    """(dimension, value, expected, ok): each dimension of a long profile of movers adds up to the flows."""
    total = flows.agg(F.sum("total").alias("expected"))
    rows = profile.groupBy("dimension").agg(F.sum("total").alias("value")).join(F.broadcast(total))
    return rows.select("dimension", "value", "expected", (F.abs(F.col("value") - F.col("expected")) < 1e-6).alias("ok"))


def check_identities(units: DataFrame, flows: DataFrame) -> DataFrame:
    """Sum of inflows = of outflows = of flows; net sums to 0."""
    u = units.agg(F.sum("inflow").alias("i"), F.sum("outflow").alias("o"), F.sum("net").alias("net"))
    f = flows.agg(F.sum("total").alias("t"))
    j = u.join(F.broadcast(f))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), e.alias("expected")) for n, v, e in (("in_out", F.col("i"), F.col("o")), ("in_flows", F.col("i"), F.col("t")), ("net", F.col("net"), F.lit(0.0)))))
    return j.select(F.explode(rows).alias("x")).select("x.*", (F.abs(F.col("x.value") - F.col("x.expected")) < 1e-6).alias("ok"))


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows, columns, digest): a digest of the rows that does not depend on their order."""
    def one(name: str, df: DataFrame) -> DataFrame:
        columns = sorted(df.columns)
        digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
        return df.agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(columns)).alias("columns"), "digest")

    return reduce(DataFrame.unionByName, (one(n, d) for n, d in tables.items()))


def verify_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(name, state): missing, extra, changed or same."""
    a, b = manifest.select("name", F.col("digest").alias("was"), F.col("columns").alias("had")), current.select("name", F.col("digest").alias("is"), F.col("columns").alias("has"))
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "extra").when((F.col("was") != F.col("is")) | (F.col("had") != F.col("has")), "changed").otherwise("same")
    return a.join(b, "name", "full").select("name", state.alias("state"))

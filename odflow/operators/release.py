"""Disclosure control: what may be published. The audit in ``audit.py`` is written apart and shares the limits only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.recode import band_n, precision_class, round_base
from odflow.spec import Limits


def passes(limits: Limits, n: str = "n", n_psu: str = "n_psu") -> Column:
    """The floors of persons and, where there are household ids, of households; unknown counts do not pass."""
    ok = F.col(n) >= limits.persons
    if limits.psus is not None:
        ok &= F.col(n_psu) >= limits.psus
    return F.coalesce(ok, F.lit(False))


def suppress_rows(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.filter(passes(limits))


def suppress_long(df: DataFrame, keys: Sequence[str], limits: Limits = Limits(), other: str = "other", nulls: str = "fold") -> DataFrame:
    """Failing cells are folded into one residual of their group and dimension. nulls: null categories are folded too, or dropped."""
    if nulls not in ("fold", "drop"):
        raise ValueError(f"nulls: fold or drop, not {nulls}")
    ok = passes(limits) & F.col("category").isNotNull()
    known = df if nulls == "fold" else df.filter("category is not null")
    folded = known.withColumn("category", F.when(ok, F.col("category")).otherwise(F.lit(other)))
    return folded.groupBy(*keys, "dimension", "category").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def mask_detail(df: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """Detail columns only of cells with enough persons."""
    return df.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in columns})


def publish_flows(matrix: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Released flow table: rows over the floors, rounded totals, bands instead of counts, a precision class."""
    return suppress_rows(matrix, limits).select("o", "d", round_base("total", limits.base).alias("total"), "se", "cv", band_n("n").alias("n_band"), precision_class("cv").alias("precision"))


def complementary(df: DataFrame, keys: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """kept: where exactly one cell of a group fails, the smallest passing one goes too, so that no difference tells it."""
    group = Window.partitionBy(*keys)
    ok = passes(limits).cast("int")
    marked = df.withColumn("ok", ok).withColumn("failed", F.sum(1 - F.col("ok")).over(group))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ok"), "total", "category"))
    return marked.withColumn("kept", (F.col("ok") == 1) & ~((F.col("failed") == 1) & (place == 1))).drop("ok", "failed")


def audit_differencing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of a table with a column ``kept`` that lack exactly one cell: its value is the total less the others."""
    gone = df.groupBy(*keys).agg(F.count(F.when(~F.col("kept"), 1)).alias("gone"), F.count(F.lit(1)).alias("cells"))
    return gone.filter("gone = 1 and cells > 1").select(*keys, "cells")


def suppress_wide(df: DataFrame, keys: Sequence[str], dims: Mapping[str, Sequence[str]], universes: Mapping[str, Column] = {}, least: int = 5, other: str = "other") -> DataFrame:
    """total, n, n_psu and a column <dim>__<category> for each listed category of each cell of persons.

    A category of fewer than ``least`` persons is null, and its total goes to <dim>__other with the categories that are not
    listed, so a dimension's columns add up to its total. Households are grouped first, so n_psu needs no Expand.
    """
    sums, counts, final = [], [], []
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for dim, categories in dims.items():
        inside = universes.get(dim, F.lit(True))
        residual = zero(F.sum(f"_w_{dim}"))
        sums.append(F.sum(F.when(inside & F.col(dim).isNotNull() & ~F.col(dim).isin(*categories), F.col("weight"))).alias(f"_w_{dim}"))
        for c in categories:
            at = inside & (F.col(dim) == c)
            name = f"{dim}__{c}"
            sums.append(F.sum(F.when(at, F.col("weight"))).alias(f"_w_{name}"))
            counts.append(F.count(F.when(at, 1)).alias(f"_n_{name}"))
            ok = F.sum(f"_n_{name}") >= least
            final.append(F.when(ok, zero(F.sum(f"_w_{name}"))).alias(name))
            residual += F.when(ok, 0.0).otherwise(zero(F.sum(f"_w_{name}")))
        final.append(residual.alias(f"{dim}__{other}"))
    by_psu = df.groupBy(*keys, "psu").agg(F.sum("weight").alias("_z"), F.count(F.lit(1)).alias("_n"), *sums, *counts)
    return by_psu.groupBy(*keys).agg(F.sum("_z").alias("total"), F.sum("_n").alias("n"), F.count("psu").alias("n_psu"), *final)


def _shown(limits: Limits, digits: bool = True) -> list[Column]:
    one = lambda c, d: F.round(c, d).alias(c)
    return [round_base("total", limits.base).alias("total"), *((one("se", 1), one("cv", 2)) if digits else (F.col("se"), F.col("cv"))), band_n("n").alias("n_band"), precision_class("cv").alias("precision")]


def publish_profiled_flows(cells: DataFrame, matrix: DataFrame, limits: Limits = Limits(), digits: bool = True) -> DataFrame:
    """Released flows of ``suppress_wide`` cells (o, d) with se and cv of ``matrix``: detail only where there are enough persons."""
    detail = [c for c in cells.columns if "__" in c]
    rows = suppress_rows(cells, limits).join(matrix.select("o", "d", "se", "cv"), ["o", "d"], "left")
    shown = [F.when(F.col("n") >= limits.detail, round_base(c, limits.base)).alias(c) for c in detail]
    return rows.select("o", "d", *_shown(limits, digits), (F.col("n") >= limits.detail).alias("has_detail"), *shown)


def publish_units(units: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Released ``flows.unit_indicators``: totals to the base, rates, errors and cv rounded, bands for counts, precision of both ends."""
    totals = ("pop", "pop5", "inflow", "unknown_origin", "international", "outflow", "net")
    digits = {"in_rate": 2, "out_rate": 2, "net_rate": 2, "effectiveness": 4, "se_in": 1, "se_out": 1, "se_net": 1, "cv_in": 2, "cv_out": 2}
    bands = [band_n(f"n_{x}").alias(f"{x}_band") for x in ("in", "out")]
    classes = [precision_class(f"cv_{x}").alias(f"precision_{x}") for x in ("in", "out")]
    return units.select("unit", *(round_base(c, limits.base).alias(c) for c in totals), *(F.round(c, d).alias(c) for c, d in digits.items()), *bands, *classes)


def publish_profile(profile: DataFrame, keys: Sequence[str], limits: Limits = Limits(), pairs: DataFrame | None = None, nulls: str = "fold") -> DataFrame:
    """Released long profile: failing cells folded (nulls: see ``suppress_long``); with ``pairs`` (keys, n, n_psu) only for pairs that pass the floor of detail."""
    rows = profile
    if pairs is not None:
        enough = F.col("n") >= limits.detail
        if limits.psus is not None:
            enough &= F.col("n_psu") >= limits.psus
        rows = rows.join(pairs.filter(enough).select(*keys), list(keys), "left_semi")
    return suppress_long(rows, keys, limits, nulls=nulls).select(*keys, "dimension", "category", round_base("total", limits.base).alias("total"), band_n("n").alias("n_band"))


def publish_cells(cells: DataFrame, keys: Sequence[str], limits: Limits = Limits(), extra: Sequence[str] = (), digits: bool = True) -> DataFrame:
    """Released commuting, level and metropolitan tables: rows over the floors, rounded totals, bands; se and cv if there are any."""
    estimate = _shown(limits, digits) if "cv" in cells.columns else [round_base("total", limits.base).alias("total"), band_n("n").alias("n_band")]
    return suppress_rows(cells, limits).select(*keys, *estimate, *extra)


def suppression_report(matrix: DataFrame, published: DataFrame) -> DataFrame:
    """One row: pairs, published ones, and the percent of the volume that they hold; null without volume."""
    a = matrix.agg(F.count(F.lit(1)).alias("pairs"), F.sum("total").alias("volume"))
    kept = matrix.join(published.select("o", "d"), ["o", "d"], "left_semi").agg(F.count(F.lit(1)).alias("published"), F.sum("total").alias("kept"))
    return a.join(F.broadcast(kept)).select("pairs", "published", F.try_divide(100 * F.col("kept"), "volume").alias("pct_volume"))

"""Weighted cell estimates, their sampling variance, and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stratum_frame(persons: DataFrame) -> DataFrame:
    """(stratum, n_h): households of each stratum, those without movers included. Distinct first, then a count."""
    return persons.select("stratum", "psu").distinct().groupBy("stratum").agg(F.count(F.lit(1)).alias("n_h"))


def cell_estimate(df: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """total, n, n_psu of each cell. Grouping by household first keeps n_psu exact with no Expand and pre-aggregates."""
    by_psu = df.groupBy(*keys, "psu").agg(F.sum("weight").alias("z"), F.count(F.lit(1)).alias("n"))
    return by_psu.groupBy(*keys).agg(F.sum("z").alias("total"), F.sum("n").alias("n"), F.count("psu").alias("n_psu"), *extra)


def cell_variance(df: DataFrame, keys: Sequence[str], frame: DataFrame) -> DataFrame:
    """total, n, n_psu, variance: ultimate clusters within strata, n_h / (n_h - 1) * (S2 - S1^2 / n_h).

    S1 and S2 sum households' totals z and z^2; households without a member in the cell add 0 and are never made. A
    stratum of one household adds nothing. The frame has a row a stratum; Spark broadcasts it when it is small.
    """
    by_psu = df.groupBy(*keys, "stratum", "psu").agg(F.sum("weight").alias("z"), F.count(F.lit(1)).alias("n"))
    by_stratum = by_psu.groupBy(*keys, "stratum").agg(
        F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("s2"), F.sum("n").alias("n"), F.count("psu").alias("n_psu")
    )
    part = F.when(F.col("n_h") > 1, F.col("n_h") / (F.col("n_h") - 1) * (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n_h"))).otherwise(0.0)
    return by_stratum.join(frame, "stratum", "left").groupBy(*keys).agg(
        F.sum("s1").alias("total"), F.sum("n").alias("n"), F.sum("n_psu").alias("n_psu"), F.sum(part).alias("variance")
    )


def se_cv(df: DataFrame) -> DataFrame:
    """se and cv (%) beside total and variance."""
    se = F.sqrt(F.greatest(F.coalesce(F.col("variance"), F.lit(0.0)), F.lit(0.0)))
    return df.withColumn("se", se).withColumn("cv", F.when(F.col("total") > 0, 100 * F.col("se") / F.col("total")))


def wide_profile(df: DataFrame, keys: Sequence[str], dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column <dim>__<category> of weighted totals each, zero where a cell has none."""
    sums = [F.coalesce(F.sum(F.when(F.col(d) == c, F.col("weight"))), F.lit(0.0)).alias(f"{d}__{c}") for d, cs in dims.items() for c in cs]
    return df.groupBy(*keys).agg(*sums)


def long_profile(df: DataFrame, keys: Sequence[str], dims: Sequence[str], universes: Mapping[str, Column] = {}) -> DataFrame:
    """(keys, dimension, category) -> total, n, n_psu in one scan and one explode; rows outside a universe are left out."""
    rows = [F.when(universes.get(d, F.lit(True)), F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category"))) for d in dims]
    cells = df.select(*keys, "psu", "weight", F.explode(F.array(*rows)).alias("c")).filter("c is not null").select(*keys, "psu", "weight", "c.dimension", "c.category")
    return cell_estimate(cells, [*keys, "dimension", "category"])


def weighted_share(predicate: Column, weight: str = "weight") -> Column:
    """Percent of the weight where the predicate holds; null without weight."""
    total = F.sum(weight)
    return F.when(total != 0, 100 * F.coalesce(F.sum(F.when(predicate, F.col(weight))), F.lit(0.0)) / total)


def composition(df: DataFrame, keys: Sequence[str], value: str = "total") -> DataFrame:
    """share (%) of each row in the positive mass of its group."""
    total = df.filter(F.col(value) > 0).groupBy(*keys).agg(F.sum(value).alias("mass"))
    return df.join(total, list(keys), "left").withColumn("share", F.when(F.col("mass") > 0, 100 * F.greatest(F.col(value), F.lit(0.0)) / F.col("mass"))).drop("mass")

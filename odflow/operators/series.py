"""Comparing editions: panels, changes, lineage, states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_panel(units: DataFrame, editions: DataFrame, measures: DataFrame) -> DataFrame:
    """Every unit in every edition, measures where there are any. The skeleton explodes the list of editions, a handful."""
    known = editions.agg(F.sort_array(F.collect_set("edition")).alias("editions"))
    return units.select("unit").join(F.broadcast(known)).select("unit", F.explode("editions").alias("edition")).join(measures, ["unit", "edition"], "left")


def edition_change(panel: DataFrame, column: str) -> DataFrame:
    """Value of the edition before, difference and ratio; null if either is."""
    before = F.lag(column).over(Window.partitionBy("unit").orderBy("edition"))
    p = panel.withColumn("before", before)
    return p.withColumns({"difference": F.col(column) - F.col("before"), "ratio": F.when(F.col("before") != 0, F.col(column) / F.col("before"))})


def top_overlap(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(unit, overlap): share of the n partners that two editions' lists have in common; a list is unit, partner, place."""
    x, y = (t.filter(F.col("place") <= n).select("unit", "partner") for t in (a, b))
    both = x.join(y, ["unit", "partner"]).groupBy("unit").agg(F.count(F.lit(1)).alias("k"))
    return x.select("unit").distinct().join(both, "unit", "left").select("unit", (F.coalesce("k", F.lit(0)) / n).alias("overlap"))


def recode_successor(df: DataFrame, columns: Sequence[str], mapping: DataFrame) -> DataFrame:
    """Codes of old units replaced by the ones used today (mapping: old, new), at each end of a flow."""
    out = df
    for c in columns:
        out = out.join(mapping.select(F.col("old").alias(c), F.col("new").alias(f"_{c}")), c, "left")
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*df.columns)


def harmonise(df: DataFrame, keys: Sequence[str], parts: Sequence[str], target: str) -> DataFrame:
    """Sum of the parts as one class; null if any part is suppressed."""
    rows = df.filter(F.col("category").isin(*parts)).groupBy(*keys)
    out = rows.agg(F.sum("value").alias("s"), F.count(F.when(F.col("value").isNull(), 1)).alias("gone"))
    return out.select(*keys, F.lit(target).alias("category"), F.when(F.col("gone") == 0, F.col("s")).alias("value"))


def coverage_state(share: str = "share", direct: str | None = None, intra: bool = False, members: str | None = None, one_member: str | None = None, other_core: str | None = None) -> Column:
    """none, insufficient (below 0.90), partial or full (0.999 on); null counts as none.

    ``share`` is the population whose territory is covered, ``direct`` the one whose units existed themselves. Measures inside
    a unit (``intra``) go by ``direct`` and need two members, more than one in the region, and the core that is in force.
    """
    pop, own = F.col(share), F.col(direct) if direct else F.lit(None).cast("double")
    out = F.when(F.coalesce(pop, F.lit(0.0)) <= 0, "none")
    if intra:
        few = F.lit(False)
        if members:
            few |= F.coalesce(F.col(members) < 2, F.lit(True))
        for c in (one_member, other_core):
            if c:
                few |= F.coalesce(F.col(c), F.lit(False))
        base = F.coalesce(own, pop)
        return out.when(few | (base < 0.90), "insufficient").when(base >= 0.999, "full").otherwise("partial")
    return out.when(pop < 0.90, "insufficient").when((pop >= 0.999) & (F.coalesce(own, F.lit(1.0)) >= 0.999), "full").otherwise("partial")


def coverage(lineage: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, edition, units, present, direct, share, state): population share whose unit existed (direct), or existed or has its
    parent in the same group (share).

    lineage: unit, edition, existed, parent; members: unit, <group>, pop.
    """
    parent = members.select(F.col("unit").alias("parent"), F.col(group).alias("parent_group"))
    j = lineage.join(members.filter(F.col(group).isNotNull()), "unit").join(parent, "parent", "left")
    existed = F.coalesce("existed", F.lit(False))
    held = existed | F.coalesce(F.col("parent_group") == F.col(group), F.lit(False))
    part = lambda p: F.when(F.sum("pop") > 0, F.coalesce(F.sum(F.when(p, F.col("pop"))), F.lit(0.0)) / F.sum("pop"))
    rows = j.groupBy(group, "edition").agg(F.count(F.lit(1)).alias("units"), F.count(F.when(existed, 1)).alias("present"), part(existed).alias("direct"), part(held).alias("share"))
    return rows.withColumn("state", coverage_state("share", "direct"))


def metro_flags(coverage_: DataFrame, expected: DataFrame, found: DataFrame, group: str = "metro") -> DataFrame:
    """coverage with one_member and other_core: a region of one present unit, a core (metro, edition, core) that is not the expected one."""
    j = coverage_.join(found.select(group, "edition", F.col("core").alias("_found")), [group, "edition"], "left").join(expected.select(group, F.col("core").alias("_expected")), group, "left")
    return j.withColumns({"one_member": F.col("present") == 1, "other_core": F.coalesce(F.col("_found") != F.col("_expected"), F.lit(False))}).drop("_found", "_expected")


def lineage_children(lineage: DataFrame) -> DataFrame:
    """(parent, unit, last_absent): units that once were part of a parent, with the last edition in which each was absent."""
    rows = lineage.groupBy("unit").agg(F.max(F.when(~F.col("existed"), F.col("edition"))).alias("last_absent"))
    return lineage.filter("parent is not null").select("parent", "unit").distinct().join(rows, "unit").select("parent", "unit", "last_absent")


def lineage_report(lineage: DataFrame, members: DataFrame, group: str, editions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edition, method, units); (edition, groups) with a present member; (unit, editions) of units without a full set of rows."""
    methods = lineage.groupBy("edition", "method").agg(F.count(F.lit(1)).alias("units"))
    present = lineage.filter("existed").join(members.select("unit", group).filter(F.col(group).isNotNull()), "unit").groupBy("edition").agg(F.countDistinct(group).alias("groups"))
    short = members.select("unit").join(lineage.select("unit", "edition").distinct(), "unit", "left").groupBy("unit").agg(F.count("edition").alias("editions")).filter(F.col("editions") < editions)
    return methods, present, short


def lineage_parent(lineage: DataFrame) -> DataFrame:
    """(unit, parent, last_absent): parent in the last edition in which the unit was absent."""
    return lineage.filter("not existed").groupBy("unit").agg(F.max_by("parent", "edition").alias("parent"), F.max("edition").alias("last_absent"))


def resolve_core(dim: DataFrame, cores: DataFrame, pop: DataFrame) -> DataFrame:
    """(metro, core): the named core if it is a member, else the most populous member (ties: the higher code)."""
    members = dim.filter("metro is not null").select("metro", "unit").join(pop.select("unit", "pop"), "unit", "left")
    named = members.join(cores.select("metro", F.col("core").alias("unit")), ["metro", "unit"], "left_semi").select("metro", F.col("unit").alias("named"))
    first = F.row_number().over(Window.partitionBy("metro").orderBy(F.desc_nulls_last("pop"), F.desc("unit")))
    largest = members.withColumn("place", first).filter("place = 1").select("metro", F.col("unit").alias("largest"))
    return largest.join(named, "metro", "left").select("metro", F.coalesce("named", "largest").alias("core"))

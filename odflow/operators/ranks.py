"""Exact places in one order of a whole table, with no task that sees all of it.

Rows are range-partitioned and sorted where they lie; a row's place is its place in its partition and what stands in earlier ones. Only
the partitions' row counts, as many numbers as there are partitions, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.sources.store import cut

_PLACE = (1 << 33) - 1


def _spread(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """df in order over its partitions, written: beside its columns _part and, counted from 0 in each partition, _place."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    """What stands before each partition."""
    at, out = 0, {}
    for part in sorted(sizes):
        out[part], at = at, at + sizes[part]
    return out


def numbered(df: DataFrame, by: Sequence[Column], name: str = "position", start: int = 1) -> DataFrame:
    """df with its row number in the order ``by``, which should end in a unique key: rows alike in it are numbered anyhow."""
    spread = _spread(df, by)
    sizes = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = df.sparkSession.createDataFrame(sorted(_starts(sizes).items()), "_part int, _before long")
    # one row a partition: the table is as small as the list of partitions
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before") + start).select(*df.columns, name)


def values_at(df: DataFrame, column: str, places) -> tuple[int, dict[int, object]]:
    """(n, {place: value}): the values at some places, from 0, of the n non-null ones in rising order.

    ``places`` makes the list of places from n; those outside of 0 to n - 1 are left out. Equal values are counted before they are
    ordered. Only partitions that hold a place are looked at again, and in each of them a running count finds it.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    spread = _spread(counts, [F.col("v")])
    sizes = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.sum("c").alias("n")).collect()}
    n, starts = sum(sizes.values()), _starts(sizes)
    wanted = {p: max(q for q in starts if starts[q] <= p and sizes[q]) for p in set(places(n)) if 0 <= p < n}
    if not wanted:
        return n, {}
    near = spread.filter(F.col("_part").isin(*sorted(set(wanted.values()))))
    run = F.sum("c").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    upto = near.select("_part", "v", run.alias("upto"))
    # a place is at the first value of its partition whose running count goes beyond it
    first = [F.min(F.when((F.col("_part") == part) & (F.col("upto") > p - starts[part]), F.col("v"))) for p, part in wanted.items()]
    found = upto.agg(*(f.alias(f"p{k}") for k, f in enumerate(first))).first()
    return n, dict(zip(wanted, found))

"""Readers and writers of survey files."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from odflow.functions.recode import safe_num


def read_delimited(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Text columns of several files, united by name: a multi-path read would bind later headers by position."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    for path in paths:
        groups[tuple(spark.read.csv(path, header=True, inferSchema=False, sep=sep).columns)].append(path)
    frames = [spark.read.csv(own, header=True, inferSchema=False, sep=sep) for own in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[tuple[str, int, int, str, int]], min_length: int = 0) -> DataFrame:
    """layout: (name, start from 1, length, type, implied decimals); lines shorter than ``min_length`` are left out."""
    return spark.read.text(path).filter(F.length("value") >= min_length).select(*_fields(layout))


def _fields(layout: Sequence[tuple[str, int, int, str, int]]) -> list[Column]:
    columns = []
    for name, start, length, kind, decimals in layout:
        text = F.substring("value", start, length)
        value = F.when(F.trim(text) != "", F.trim(text)) if kind == "string" else safe_num(text, kind)
        columns.append((value / float(10**decimals) if decimals else value).alias(name))
    return columns


def reject_short(lines: DataFrame, min_length: int) -> tuple[DataFrame, DataFrame]:
    """(lines long enough, one row of counts: good, bad) of a text column ``value``; null is short. Two scans if both are used."""
    ok = F.coalesce(F.length("value") >= min_length, F.lit(False))
    return lines.filter(ok), lines.agg(F.count(F.when(ok, 1)).alias("good"), F.count(F.when(~ok, 1)).alias("bad"))


@dataclass(frozen=True)
class Check:
    """A number of a table, an aggregate of its rows, and whether it is as it should be: between low and high, either may be open."""

    name: str
    value: Column
    low: float | None = None
    high: float | None = None

    def passed(self, value: float | None) -> bool:
        return value is not None and (self.low is None or value >= self.low) and (self.high is None or value <= self.high)


def write_checked(df: DataFrame, path: str, checks: Sequence[Check], before: Sequence[Check] = (), keep: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Write df as Parquet and return (name, value, low, high, ok) of the checks, all from the pass that writes.

    ``checks`` are taken of the rows that are written, ``before`` of all rows of df, of which ``keep`` lets some through (null does not). ``columns``: those that are written, all if None.
    Spark gathers the numbers as the rows go by, so there is no second scan; a task that runs again counts once, as long as nothing
    is shuffled after the observed rows. A failed check does not stop the write: the caller decides.
    """
    seen: list[tuple[Sequence[Check], Observation]] = []

    def watched(rows: DataFrame, own: Sequence[Check]) -> DataFrame:
        if not own:
            return rows
        seen.append((own, Observation()))
        return rows.observe(seen[-1][1], *(c.value.alias(c.name) for c in own))

    rows = watched(df, before)
    rows = rows.filter(F.coalesce(keep, F.lit(False))) if keep is not None else rows
    rows = rows.select(*columns) if columns else rows
    watched(rows, checks).write.mode("overwrite").parquet(path)
    found = []
    for own, observation in seen:
        numbers = observation.get
        for c in own:
            value = None if numbers[c.name] is None else float(numbers[c.name])
            found.append((c.name, value, *(None if x is None else float(x) for x in (c.low, c.high)), c.passed(value)))
    return df.sparkSession.createDataFrame(found, "name string, value double, low double, high double, ok boolean")


def load_fixed_width(spark: SparkSession, path: str, layout: Sequence[tuple[str, int, int, str, int]], out: str, min_length: int, most_bad: int | None = None, checks: Sequence[Check] = ()) -> DataFrame:
    """Fixed-width lines to a Parquet table, short ones left out: the checks, with lines, rejected and those of the table, in one pass."""
    lines = spark.read.text(path)
    ok = F.coalesce(F.length("value") >= min_length, F.lit(False))
    table = lines.withColumn("_ok", ok).select("_ok", *_fields(layout))
    before = [Check("lines", F.count(F.lit(1))), Check("rejected", F.count(F.when(~F.col("_ok"), 1)), None, most_bad)]
    return write_checked(table, out, checks, before, F.col("_ok"), [name for name, *_ in layout])


def read_parts(spark: SparkSession, paths: Sequence[str], expected: int) -> DataFrame:
    """One table from Parquet parts; an error if not every expected part is there with rows."""
    df = spark.read.parquet(*paths)
    found = df.select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("part")).distinct().count()
    if len(set(paths)) != expected or found != expected:
        raise ValueError(f"{found} of {expected} parts have rows")
    return df


def patch_rows(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows whose key was issued again come from the patch alone."""
    return base.join(patch.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(patch.select(*base.columns))


def project_contract(df: DataFrame, spec: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """(name, source column or None, type): renamed, cast, or a typed null."""
    return df.select(*((F.col(source).cast(kind) if source else F.lit(None).cast(kind)).alias(name) for name, source, kind in spec))


def write_table(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_row_arrays(df: DataFrame, path: str, order: Sequence[str], digits: int | None = None) -> None:
    """One JSON array a line, in the order of keys; numbers stay numbers, fractions are rounded, nulls are null."""
    def cell(name: str, kind: str):
        c = F.round(name, digits) if digits is not None and kind in ("double", "float") else F.col(name)
        # the value of a struct with one field, without its braces and name
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(6), F.length(text) - 6)

    cells = [cell(n, k) for n, k in df.dtypes]
    df.orderBy(*order).select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, attribution: str | None = None, keep=None) -> None:
    """CSV with a header, of the rows where ``keep`` holds; the attribution is a column of its own."""
    rows = df.filter(keep) if keep is not None else df
    rows = rows.withColumn("source", F.lit(attribution)) if attribution else rows
    rows.write.mode("overwrite").csv(path, header=True)

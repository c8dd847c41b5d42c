"""Small helpers the operators share: shared tables, Arrow text buffers and bounded bit filters."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality, near-duplicate and toxicity contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one is set only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a non-null Arrow string or binary array end to end, and its n + 1 offsets, without a copy."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def slices(batches, column: str, most: int = 2 << 20, rows: int = 1 << 30):
    """The batches' rows in order, in slices of about ``most`` bytes of a string column (one row at least, ``rows`` at most)."""
    for batch in batches:
        _, ends = string_bytes(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches, keys: list[str]):
    """Rows sorted by ``keys`` as (table, bounds of its groups): no group is split over two tables.

    Memory is a batch and the longest group.
    """
    import pyarrow as pa

    held, last = [], None

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        value = np.stack([table[c].to_numpy() for c in keys])
        return table, np.concatenate([[0], np.flatnonzero((value[:, 1:] != value[:, :-1]).any(axis=0)) + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.stack([batch.column(c).to_numpy() for c in keys])
        if held and (value[:, 0] != last).any():
            yield whole()
            held = []
        last = value[:, -1]
        change = np.flatnonzero((value[:, 1:] != value[:, :-1]).any(axis=0))
        if len(change):
            held.append(batch.slice(0, int(change[-1]) + 1))
            yield whole()
            held = []
            batch = batch.slice(int(change[-1]) + 1)
        held.append(batch)
    if held:
        yield whole()


class BitFilter:
    """A Bloom filter over 64-bit names with two probes.

    Its size is fixed by ``bits`` whatever the data, so it may be broadcast. It only spares work: what it lets
    through is grouped exactly afterwards, so a full filter costs shuffle volume and never changes a result.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    @staticmethod
    def probes(bits: int) -> tuple:
        """Columns of the two bit numbers of a name in column ``name``."""
        name = F.col("name")
        return (name.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(name, 33).bitwiseAND(F.lit(bits - 1)))

    @classmethod
    def of(cls, names: DataFrame, bits: int = 1 << 26) -> "BitFilter":
        """From a DataFrame with one long column ``name``; at most bits / 64 words reach the driver."""
        bit = F.explode(F.array(*cls.probes(bits))).alias("bit")
        rows = (
            names.select(bit)
            .select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
            .groupBy("word")
            .agg(F.bit_or("mask").alias("mask"))
        )
        got = rows.toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, names: np.ndarray) -> np.ndarray:
        names = names.view(np.uint64)
        out = np.ones(len(names), bool)
        for bit in (names & np.uint64(self.bits - 1), (names >> np.uint64(33)) & np.uint64(self.bits - 1)):
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out

"""Tables that many queries share, worked out once and kept in the folder that all machines reach.

A table is written as buckets of a key, each sorted by it, and read as such: groups and joins on the key, or on more than the key,
need no shuffle. It is found again while the files that it was made from are the same; a lost executor reads it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the sources that one bucket stands for, and the most buckets that Spark takes by default.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 100_000

#: Names of stored tables by application, name and stamps of the sources.
_MADE: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a file or folder changed: its bytes, files and time, in two calls whatever its size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = system.getContentSummary(at)
    return path, whole.getLength(), whole.getFileCount(), system.getFileStatus(at).getModificationTime()


def once(spark: SparkSession, name: str, sources: Sequence[str], make: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """The table ``name`` made from the files ``sources``: written at the first call, read at later ones.

    With ``key`` it is in buckets of that column, sorted by it: one for every BUCKET_BYTES of the sources, and no fewer than cores. Joins
    and groups in its making have as many partitions, so Spark leaves out the exchange into buckets where the last of them is by the key.
    """
    stamps = [stamp(spark, p) for p in sources]
    at = (spark.sparkContext.applicationId, name, *stamps)
    if at not in _MADE:
        table = f"odflow_{name}_{uuid.uuid4().hex}"
        df = make()
        parts = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-sum(s[1] for s in stamps) // BUCKET_BYTES)))
        out = df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key) if key else df.write
        # exchanges end with the write: their files, larger than the table, would lie on the disks until the driver collects garbage
        with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.shuffle.partitions": str(parts)} if key else {})):
            out.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
        _MADE[at] = table
    return spark.table(_MADE[at])


@contextmanager
def _set(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session's settings for the time of a write."""
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and its size is known.

    Rounds of joins need the latter: a checkpoint keeps the estimate of its plan, which every further join multiplies.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

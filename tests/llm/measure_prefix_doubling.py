"""Not a test: what op1 takes if every position carries a (position, rank) pair, as a sum for the README.

``python tests/llm/measure_prefix_doubling.py DIR`` ranks all positions of the texts of DIR/documents.parquet by their first 32
bytes, then by 64 and 100, keeps those whose rank repeats, and prints rows, shuffle and seconds of each round.
"""

from __future__ import annotations

import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from odflow.llm.common import slices, stored, string_bytes, table


def positions(batches):
    """(doc, pos, rank): the 64-bit name of the 32 bytes at each position."""
    from odflow.llm.suffix_dedup import ANCHOR, Cells

    for batch in slices(batches, "text", most=1 << 20):
        body, ends = string_bytes(batch.column("text"))
        own = Cells.__new__(Cells)
        own.body = body
        names = own._names(0, len(body))
        for i, key in enumerate(batch.column("key").to_pylist()):
            n = int(ends[i + 1] - ends[i]) - ANCHOR + 1
            if n > 0:
                pos = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int64)), pa.array(pos), pa.array(names[ends[i] : ends[i] + n].view(np.int64))], ["doc", "pos", "rank"])


def repeated(pairs):
    """The pairs whose rank two positions or more carry, by sorting them on rank."""
    return pairs.selectExpr("doc", "pos", "rank", "count(*) OVER (PARTITION BY rank) AS n").filter("n > 1").drop("n")


def rounds(docs, goals=(32, 64, 100)):
    """(length, pairs whose string of that length repeats) for growing lengths; docs are (key, text)."""
    pairs, length = None, 0
    for goal in goals:
        if pairs is None:
            new = docs.mapInArrow(positions, "doc long, pos int, rank long")
        else:
            further = pairs.select("doc", (F.col("pos") - (goal - length)).alias("pos"), F.col("rank").alias("next"))
            new = pairs.join(further, ["doc", "pos"]).select("doc", "pos", F.xxhash64("rank", "next").alias("rank"))
        pairs, length = stored(repeated(new)), goal
        yield goal, pairs


def keyed(docs):
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def shuffled(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "128").config("spark.ui.enabled", "false").getOrCreate()
    docs = keyed(table(spark, folder, "documents"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    print(f"texts: {size / 1e9:.3f} GB", flush=True)
    before, start = shuffled(spark), time.time()
    for goal, pairs in rounds(docs):
        rows, now = pairs.count(), shuffled(spark)
        print(f"length {goal}: {rows} positions repeat, shuffle {(now - before) / 1e9:.2f} GB, {(now - before) / size:.1f} x the texts, {time.time() - start:.0f} s", flush=True)
        before, start = now, time.time()


if __name__ == "__main__":
    main(sys.argv[1])

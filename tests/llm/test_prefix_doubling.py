"""op1 on a whole table against plain prefix doubling over all positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.llm import queries
from odflow.llm.common import table
from tests.llm.measure_prefix_doubling import keyed, rounds

DIR = "/root/testdata/sf0.01"


def test_suffix_dedup_equals_doubling_over_all_positions(spark):
    *_, (length, pairs) = rounds(keyed(table(spark, DIR, "documents")))
    first = pairs.groupBy("rank").agg(F.min(F.struct("doc", "pos")).alias("first"))
    later = pairs.join(first, "rank").filter(F.struct("doc", "pos") != F.col("first"))
    starts: dict[int, list[int]] = {}
    for doc, pos in later.select("doc", "pos").collect():
        starts.setdefault(doc, []).append(pos)
    want = {}
    for doc, found in starts.items():
        removed, spans, end = 0, 0, -1
        for pos in sorted(found):
            spans += pos > end
            removed += pos + length - max(pos, end)
            end = pos + length
        want[doc] = (removed, spans)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in queries.op1_suffix_dedup(spark, DIR).collect()}
    assert len(got) == table(spark, DIR, "documents").count() and len(want) > 100
    assert got == {doc: want.get(doc, (0, 0)) for doc in got}

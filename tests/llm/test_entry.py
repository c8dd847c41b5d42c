"""The entry registers every training-data query: a wrong import must not take them away unseen."""

import __spark_entry__


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert {"op6_quality", "op9_near_dedup", "op11_merkle_manifest", "op12_warc", "op13_source_divergence"} <= set(__spark_entry__.oracle_sql())

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from odflow.plans.queries import QUERIES, Survey

NAMES = ("published_flow_matrix", "flow_matrix", "long_profile", "suppressed_profile", "rollup_flows", "unit_indicators", "audit_of_a_loose_release", "fitted_flows")


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": "file:///tmp/odflow-bench-checkpoints"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # an untimed scan first: the JVM's start is no query's work
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    took = {}
    # the persons that all queries read are worked out and stored once; their time is part of the sum
    began = time.time()
    Survey(spark, folder).persons
    took["stored_persons"] = round(time.time() - began, 3)
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "survey_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

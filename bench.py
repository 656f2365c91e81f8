"""Times the headline queries on local Spark: one warm-up, then one timed run each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from chunkflow.queries import QUERIES

HEADLINE = ["preprocess_documents", "paragraph_chunks", "word_chunks", "structured_blocks", "translate_documents"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

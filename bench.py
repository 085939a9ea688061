"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of cores. Each query is run in full (written to
the null sink) after one warm-up query, so that starting Spark is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = ["s1_tokens", "s2_token_offsets", "c1_windows", "c6_chunk_texts", "e1_shape_entities", "e4_classification", "e5_counted_relations", "e6_relations", "e7_counted_records", "e12_attributes", "t1_pool", "o1_greedy", "o2_flat", "k9_constrained_decode", "p4_extract_entities", "e15_all_tasks"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "0").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sievework.catalog import QUERIES, read

    read(spark, sf, "documents").count()
    taken = {}
    for name in HEADLINE:
        begun = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - begun, 3)
    docs = read(spark, sf, "documents").count()
    tokens = QUERIES["s1_tokens"](spark, sf).agg({"n_tokens": "sum"}).first()[0]
    # time against rows from the tables ten times smaller, as a guard that nothing grows faster than its input
    small, scaling = str(Path(sf).parent / "sf0.01"), {}
    if Path(small).name != Path(sf).name and Path(small).exists():
        for name in ("s1_tokens", "c6_chunk_texts", "e15_all_tasks"):
            begun = time.time()
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
            scaling[name] = round(taken[name] / (time.time() - begun), 2)
        scaling["rows"] = round(docs / read(spark, small, "documents").count(), 2)
    total = round(sum(taken.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": taken, "sf": sf, "documents": docs, "documents_per_sec_all_tasks": round(docs / taken["e15_all_tasks"], 1), "tokens_per_sec": {k: round(tokens / taken[k]) for k in ("s1_tokens", "c6_chunk_texts", "p4_extract_entities", "e15_all_tasks")}, "times_sf0.01": scaling}))
    spark.stop()


if __name__ == "__main__":
    main()

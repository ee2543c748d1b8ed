"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query is written to the noop sink, so every row and column is made; the better of
two runs counts, after one run that loads classes.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import SparkSession

from tidewheel.plans import catalogue

HEADLINE = ["window_agg_final", "running_output", "lineitem_agg_final", "compact_latest_output", "replay_state", "restore_replay_state", "decode_orders", "encode_output", "batch_offsets", "stream_window_agg", "stateful_running_output"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timed("window_agg_final")
    queries = {name: round(min(timed(name) for _ in range(2)), 3) for name in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": Path(sf_dir).name.removeprefix("sf"),
        "lineitem_rows_per_sec": round(rows / queries["lineitem_agg_final"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

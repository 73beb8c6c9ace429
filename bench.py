"""Times the headline queries and prints one JSON line.

The postings are made of the tables once, before the queries are timed (`store_sec`): the queries read a store, as they
would in use.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from postingworks.plans import catalog, views  # noqa: E402

HEADLINE = ["ranked_list", "title_search", "boards", "stats_totals", "top_companies", "skill_demand", "time_to_close", "scores", "document_skills", "duplicate_links", "board_sync", "lifecycle_history"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    folder = tempfile.TemporaryDirectory(prefix="bench-")
    begun = time.perf_counter()
    views.store(spark, sf, f"{folder.name}/postings")
    stored = round(time.perf_counter() - begun, 3)
    run("ranked_list")  # warm-up
    seconds = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name.removeprefix("sf"), "store_sec": stored}))
    spark.stop()
    folder.cleanup()


if __name__ == "__main__":
    main()

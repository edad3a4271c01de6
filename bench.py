"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Tables
are first copied into as many files as there are cores, as a file of one row group is read by one task.
Every query is planned and run from scratch and its whole result is produced (``noop`` sink); the first
one is run once before the clock starts, so it does not stand for the start of the session.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from cloakframe.session import build_session
from queries import QUERIES

HEADLINE = (
    "mask_documents",
    "mask_pages",
    "analyze_text",
    "findings",
    "resolve_overlaps",
    "mask_with_stats",
    "mask_mixed_modes",
    "mask_hmac",
    "mask_preserve_format",
    "mask_table",
    "mask_nested",
    "mask_json",
    "mask_log",
    "mask_sql_dump",
    "file_report",
    "batch_report",
    "column_profile",
    "build_mapping",
    "demask",
    "mask_with_cache",
    "ner_resolve",
    "mask_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            # Call sites of single expressions, looked up for every one of them, are not needed here.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/{name}")
        rows.repartition(int(cpus)).write.parquet(f"{folder}/{name}")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()

    seconds, failed = {}, {}
    for name in HEADLINE:
        started = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the others are timed all the same
            failed[name] = f"{type(error).__name__}: {error}"[:200]
            continue
        seconds[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))
    shutil.rmtree(folder)
    spark.stop()


if __name__ == "__main__":
    main()

"""Rows out, seconds and shuffle bytes of registered queries: measure.py <sf_dir> <query>..."""

from __future__ import annotations

import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def shuffle_bytes(spark, seen: set[int]) -> int:
    """Shuffle bytes written by stages not seen before."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    total = 0
    for i in range(stages.size()):
        s = stages.apply(i)
        if s.stageId() not in seen:
            seen.add(s.stageId())
            total += s.shuffleWriteBytes()
    return total


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        rows = queries()[name](spark, sf_dir).count()
        seen: set[int] = set()
        shuffle_bytes(spark, seen)
        times, moved = [], []
        for _ in range(3):
            start = time.perf_counter()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            moved.append(shuffle_bytes(spark, seen))
        print(f"{name} rows={rows} seconds={statistics.median(times):.2f} shuffle_mb={statistics.median(moved) / 1e6:.1f}", flush=True)


if __name__ == "__main__":
    main()

"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else v) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    return [names[i] for i in order], rows


def same_value(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(got, want):
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])} rows; first {got[1][:2]} / {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        if not all(map(same_value, a, b)):
            return f"row {a} != {b}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = spark_rows(run(spark, sf_dir))
            t1 = time.time()
            want = oracle_rows(con, oracle_sql()[name])
            diff = difference(got, want)
            n = len(got[1])
        except Exception as e:  # report and go on with the next query
            t1, diff, n = time.time(), f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} rows={n:<8d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s", diff or "", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

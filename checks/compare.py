"""Run registered jobs and their SQL side by side: python -m checks.compare [sf_dir] [name …]"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracles import ORACLES

TABLES = ("pages", "events")


def normalized(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple("<null>" if v is None or v != v else str(v) for v in r)
            for r in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' when equal, else what differs."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normalized(got), normalized(want)
    if a == b:
        return ""
    only_a, only_b = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)}; {sorted(got.columns)}; spark only {only_a}; sql only {only_b}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, name) if name in ORACLES else "no sql"
        except Exception as e:  # report and go on with the next job
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'OK  ' if not diff else 'DIFF'} {name} {time.time() - t:.1f}s {diff[:1200]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")


if __name__ == "__main__":
    main()

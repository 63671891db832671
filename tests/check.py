"""python tests/check.py <sf> [key ...]: run queries against their SQL and print what differs."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import compare, connect


def main():
    sf, keys = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "10g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(folder), entry.oracle_sql()
    bad = []
    for key, build in entry.queries().items():
        if keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in keys):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if key in oracles:
                diff, n = compare(con, oracles[key], df)
            else:
                n, diff = len(df.collect()), ""
        except Exception as error:  # report and go on with the next query
            diff, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        mark = "ok " if not diff else "BAD"
        if diff:
            bad.append(key)
        print(f"{mark} {key:26} {n:7} rows {time.time() - start:6.2f}s {'' if key in oracles else '(rows only)'}"
              + (f"\n      {diff[:1600]}" if diff else ""), flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()

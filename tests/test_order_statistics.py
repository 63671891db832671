"""Places of an order without one task that sorts everything; tables whose metrics repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import relational as R
from corpusmill.operators import sections


def test_a_million_different_values(spark, tmp_path):
    df = spark.range(1_000_000).select((F.rand(3) * 2 - 1).alias("v"))
    df.write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    got = R.ranked_elements(df, F.col("v"), low=(0, 1), p10=(1, 10), median=(1, 2), high=(999_999, 1_000_000)).collect()[0]
    s = np.sort(df.toPandas()["v"].to_numpy())
    assert (got.low, got.p10, got.median, got.high) == (s[0], s[100_000], s[500_000], s[999_999])


def test_no_window_without_a_key(spark):
    df = spark.createDataFrame([(random.random(),) for _ in range(100)], "v double")
    plan = R.ranked_elements(df, F.col("v"), median=(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "partitionSpec: []" not in plan and "SinglePartition, ENSURE" not in plan.split("Window")[1].split("FileScan")[0]


@pytest.mark.parametrize("values", [[5, 1, 1, 9, 7, 7], [3], [None, 2, None], [], [None], [4] * 50 + [1], list(range(99, -1, -1))])
def test_places(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    got = R.ranked_elements(df, F.col("v"), low=(0, 1), p10=(1, 10), median=(1, 2)).collect()[0]
    s = sorted(v for v in values if v is not None)
    assert tuple(got) == ((s[0], s[len(s) // 10], s[len(s) // 2]) if s else (None, None, None))


@pytest.mark.parametrize("n", [1, 2, 5, 101])
def test_percentiles_between_neighbours(spark, n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 1000, n)
    df = spark.createDataFrame([(f"g{i % 3}", int(x)) for i, x in enumerate(v)], "g string, v int")
    got = R.distribution_stats(df, F.col("v"), "g", 1.0).collect()[0]
    for q in (50, 75, 90, 95):
        assert got[f"p{q}"] == pytest.approx(np.percentile(v, q), abs=1e-6)
    assert got.median == sorted(v)[n // 2] and got.n == n


def unpivoted(rows, periods):
    last = {r[0]: i for i, r in enumerate(rows)}
    return [(r[0], p, v) for i, r in enumerate(rows) if last[r[0]] == i for p, v in zip(periods, r[1:]) if p]


def test_repeated_metrics_keep_their_last_row(spark):
    rng = random.Random(4)
    rows = [[f"m{rng.randrange(6)}", *(str(rng.randrange(100)) for _ in range(rng.randrange(0, 4)))] for _ in range(25)]
    text = "\n".join(["## Returns and rankings", "Name | 1y | 3y | 5y", "---|---|---|---", *(" | ".join([*r, ""]) if len(r) == 1 else " | ".join(r) for r in rows)])
    got = spark.range(1).select(sections.unpivot_table(F.lit(text)).alias("t")).collect()[0].t
    rows = [[*r, ""] if len(r) == 1 else r for r in rows]
    want = unpivoted(rows, ["1y", "3y", "5y"])
    assert [(x.metric, x.period) for x in got] == [(m, p) for m, p, _ in want]
    assert [x.value for x in got if x.value] == [v for _, _, v in want if v]


def test_a_long_table_is_read_in_one_pass(spark):
    import time
    text = "\n".join(["## Returns and rankings", "Name | 1y", "---|---", *(f"m{i % 9000} | {i}" for i in range(12_000))])
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    got = df.select(F.size(sections.unpivot_table(F.col("t"))).alias("n")).collect()[0].n
    assert got == 9000 and time.time() - start < 30

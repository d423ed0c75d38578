"""Running sums over ranges against Python's."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.ranks import running_sum


@pytest.mark.parametrize("n, values", [(0, 5), (1, 5), (900, 10**6), (900, 4)])
def test_running_sum(spark, n, values):
    rng = np.random.default_rng(n + values)
    rows = [(k, int(rng.integers(0, values)), int(rng.integers(-3, 9))) for k in range(n)] + ([(n, None, 2)] if n else [])
    df = spark.createDataFrame(rows, "k int, v int, amount int")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want = {r[0]: (i + 1, s) for i, (r, s) in enumerate(zip(order, itertools.accumulate(r[2] for r in order)))}
    got = running_sum(running_sum(df, ["v", "k"], "place"), ["v", "k"], "sum", "amount")
    assert {r["k"]: (r["place"], r["sum"]) for r in got.collect()} == want


def test_descending(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    assert {r["k"]: r["p"] for r in running_sum(df, [F.desc("k")], "p").collect()} == {k: 100 - k for k in range(100)}

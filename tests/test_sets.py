"""Owners of equal sets meet by group, never pair by pair."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules

LEFT = [(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "c"), (4, "d"), (4, "e"), (5, None), (6, "f")]
RIGHT = [(10, "a"), (10, "b"), (11, "c"), (12, "c"), (13, "f"), (14, "d"), (14, "x"), (15, None)]


@pytest.mark.parametrize("clash", [False, True])
def test_same_sets(spark, monkeypatch, clash):
    if clash:  # all hashes are equal, so sets of one size have one outline
        monkeypatch.setattr(rules.F, "xxhash64", lambda c: F.length(c).cast("long"))
    left, right = (spark.createDataFrame(r, "o long, m string") for r in (LEFT, RIGHT))
    found = rules.same_sets(left, right, "o", "m")
    assert {tuple(r) for r in found.collect()} == {(1, 10), (2, 10), (6, 13)}
    assert {tuple(r) for r in rules.same_sets(left, left, "o", "m").collect()} == {(3, 3), (4, 4), (6, 6)}
    assert ("LeftAnti" in found._jdf.queryExecution().executedPlan().toString()) == clash

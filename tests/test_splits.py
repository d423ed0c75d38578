"""Greedy splits against a plain walk."""

import hashlib
from collections import Counter

from millrace.operators import splits
from millrace.plans import splits as plans

SMALL = "/root/testdata/sf0.001"


def walk(sizes, total, begun, source):
    filled = dict(begun)
    out = {}
    for group in sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(f"group|{source}|{g}".encode()).hexdigest())):
        best = max(splits.SPLITS, key=lambda s: (1 - filled[s[0]] / (s[1] * total), -splits.SPLITS.index(s)))[0]
        out[group] = best
        filled[best] += sizes[group]
    return out


def test_groups_go_where_a_plain_walk_puts_them(spark):
    sizes = {"a": 50, "b": 20, "c": 10, "d": 10, "e": 5, "f": 5}
    rows = spark.createDataFrame([("s", g) for g, n in sizes.items() for _ in range(n)], "source string, g string")
    got = {r.group: r.split for r in splits.deal_groups(rows, "source", "g").collect()}
    assert got == walk(sizes, 100, dict.fromkeys(("train", "val", "test"), 0), "s")


def test_forced_groups_keep_their_split_and_count(spark):
    sizes = {"a": 30, "b": 10, "c": 10}
    rows = spark.createDataFrame([(None, g) for g, n in sizes.items() for _ in range(n)], "source string, g string")
    forced = spark.createDataFrame([("a", "test")], "`group` string, split string")
    got = {r.group: r.split for r in splits.deal_groups(rows, "source", "g", forced).collect()}
    assert got["a"] == "test"
    assert {g: s for g, s in got.items() if g != "a"} == walk({"b": 10, "c": 10}, 50, {"train": 0, "val": 0, "test": 30}, "")


def test_no_rows_give_no_groups(spark):
    assert splits.deal_groups(spark.createDataFrame([], "source string, g string"), "source", "g").count() == 0


def test_shares_over_the_given_table(spark):
    got = plans.group_splits(spark, SMALL).collect()
    assert len({(r.source, r.group) for r in got}) == len(got)
    rows = Counter()
    for r in got:
        rows[r.split] += r.rows
    assert rows["train"] > rows["val"] > 0 and rows["test"] > 0

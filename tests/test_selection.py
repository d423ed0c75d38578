"""Selection by quotas against the walk that it stands for."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import selection


def sets_of(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def alike(a, b):
    return len(a & b) / max(len(a | b), 1)


def walk(rows, quotas, seed, threshold, words, fallback):
    pool = {}
    for k, s, t in sorted(rows, key=lambda r: r[0]):
        if t is not None and words[0] <= len(t.split()) <= words[1] and s in dict(quotas):
            pool.setdefault(re.sub("[^a-z0-9]", "", t.lower()), (k, s, t))
    order = sorted(pool.values(), key=lambda r: hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest())
    picked, lacking = [], 0
    for name, quota in quotas:
        got = []
        for k, s, t in order:
            if s != name:
                continue
            if len(got) >= quota + (lacking if name == fallback else 0):
                break
            if threshold is None or all(alike(sets_of(t), sets_of(u)) < threshold for _, u in picked + got):
                got.append((k, t))
        picked += got
        lacking += max(0, quota - len(got)) if name != fallback else 0
    return sorted(k for k, _ in picked)


def made(n, seed=0):
    """Families of near copies of different sizes, exact copies, a stratum that is nearly one family."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        family = int(rng.integers(0, 12)) if k % 3 else int(rng.integers(100, 400))
        base = np.random.default_rng(1000 + family).integers(0, 300, size=12)
        own = base.copy()
        own[: int(rng.integers(0, 3))] = rng.integers(300, 400)
        rows.append((k, ["a", "b", "c", "d", None][int(rng.integers(0, 5))], " ".join(f"W{x}" for x in own)))
    rows += [(n + k, "c", rows[0][2] + f" end{k % 9}") for k in range(60)] + [(n + 100, "a", None), (n + 101, "a", ""), (n + 102, "a", "few words"), (n + 103, "b", "--- -- - ... , ; !")]
    return rows


@pytest.mark.parametrize("threshold, quotas", [(0.6, [("a", 15), ("b", 40), ("c", 30)]), (0.9, [("c", 500), ("a", 10)]), (None, [("b", 7), ("zzz", 5), ("a", 20)]), (0.6, [])])
def test_equals_the_walk(spark, threshold, quotas):
    rows = made(300)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id int, kind string, body string, tokens int, words int")
    got = selection.select_by_quota(df, "id", "kind", "body", quotas, "s", threshold, fallback="a")
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == walk(rows, quotas, "s", threshold, (6, 60), "a")


def test_small_parts_of_the_hash_range_give_the_same(spark, monkeypatch):
    rows = made(200, 4)
    df = spark.createDataFrame(rows, "id int, kind string, body string")
    monkeypatch.setattr(selection, "PARTS", 3)
    quotas = [("a", 4), ("b", 3), ("c", 9)]
    got = selection.select_by_quota(df, "id", "kind", "body", quotas, "q", 0.6, fallback="c")
    assert sorted(r["id"] for r in got.collect()) == walk(rows, quotas, "q", 0.6, (6, 60), "c")


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    sets = [(k, sorted({f"t{x}" for x in rng.integers(0, 14, size=int(rng.integers(0, 9)))})) for k in range(120)]
    df = spark.createDataFrame(sets + [(500, None)], "key int, tokens array<string>")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and alike(set(x), set(y)) >= threshold - 1e-12}
        rows = selection.jaccard_links(df, threshold).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_independent_set_equals_the_walk(spark):
    rng = np.random.default_rng(3)
    nodes = [(k, f"{x:08x}") for k, x in enumerate(rng.permutation(150).tolist())]
    edges = {tuple(sorted(map(int, rng.integers(0, 150, size=2)))) for _ in range(400)} | {(0, k) for k in range(1, 60)}
    edges = {(a, b) for a, b in edges if a != b}
    near = Counter()
    kept = set()
    for k, _ in sorted(nodes, key=lambda n: n[1]):
        if not any((min(k, j), max(k, j)) in edges for j in kept):
            kept.add(k)
        near[k] += 1
    got = selection.first_independent(spark.createDataFrame(nodes, "key int, place string"), spark.createDataFrame(sorted(edges), "a int, b int"))
    assert {r["key"] for r in got.collect()} == kept
    alone = selection.first_independent(spark.createDataFrame(nodes, "key int, place string"), spark.createDataFrame([], "a int, b int"))
    assert alone.count() == 150


def test_first_in_order(spark):
    rows = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    want = sorted(range(500), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
    for n in (0, 1, 77, 500, 900):
        assert {r["id"] for r in selection.first_in_order(rows, "h", n).collect()} == set(want[:n])

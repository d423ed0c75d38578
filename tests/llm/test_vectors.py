import numpy as np
import pytest

from millrace.llm import vectors


def brute_force(rows, threshold):
    """rows: (id, vector) -> {id: (links, component)} for unique ids and fine vectors of one dimension"""
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (low == label).all():
            break
        label = low
    return {int(i): (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}


@pytest.mark.parametrize("threshold", [0.9, 0.35])
def test_equals_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    near = [base[i % 12] + rng.normal(size=16) * rng.uniform(0.02, 0.3) for i in range(500)]
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate([*near, *rng.normal(size=(200, 16))])]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table, threshold=threshold).collect()}
    assert got == brute_force(rows, threshold)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, None, 5), (4, [], 5), (5, [0.0, 0.0], 5), (6, [nan, 1.0], 5), (7, [inf, 1.0], 5), (8, [None, 1.0], 5), (9, [1.0], 5), (10, [0.0, 1.0], 5), (None, [3.0, 0.0], 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect())
    assert got == [(-1, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)] + [(i, 0, i, True) for i in range(3, 11)]
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs at cosines from 0.9 on in random directions, among many unrelated vectors."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.93, size=(1500, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y]))]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: n for i, (n, _) in brute_force(rows, 0.9).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


@pytest.mark.parametrize("kind", ["low rank", "clustered", "each cluster its own plane"])
def test_no_link_is_missed_on_correlated_vectors(spark, kind):
    """Vectors that vary in few directions, with partners near the threshold in these directions."""
    rng = np.random.default_rng(17)
    plane = rng.normal(size=(8, 64))
    x = rng.normal(size=(1500, 8)) @ plane
    step = rng.normal(size=(1500, 8)) @ plane
    if kind != "low rank":
        center = 2 * rng.normal(size=(30, 64))[np.arange(1500) % 30]
        spread = plane if kind == "clustered" else rng.normal(size=(30, 8, 64))[np.arange(1500) % 30]
        x = center + np.einsum("ij,...jk->ik" if kind == "clustered" else "ij,ijk->ik", rng.normal(size=(1500, 8)), spread) / 2
        step = np.einsum("ij,...jk->ik" if kind == "clustered" else "ij,ijk->ik", rng.normal(size=(1500, 8)), spread)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step -= (step * x).sum(axis=1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.93, size=(1500, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * step]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_force(rows, 0.9)


def test_very_long_and_very_short_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 1e-200]), (4, [1e-320, 2e-320]), (5, [-1e300, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}

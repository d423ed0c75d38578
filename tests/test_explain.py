"""Shapley values against the sum over all sets of features, and stored models against the models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from millrace.operators import explain, inference

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(int)
    data = [(k, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y int").cache()


def worth(nodes, tree, node, x, known):
    n = nodes[tree, node]
    if n["feature"] is None:
        return n["value"]
    left, right = (worth(nodes, tree, n[s], x, known) for s in ("left", "right"))
    if n["feature"] in known:
        return left if x[n["feature"]] <= n["threshold"] else right
    share = nodes[tree, n["left"]]["cover"] / n["cover"]
    return share * left + (1 - share) * right


def by_sets(nodes, x):
    """The definition: weighted differences over all sets of the other features."""
    d, out = len(x), []
    value = {s: sum(worth(nodes, t, 0, x, s) for t in {t for t, _ in nodes}) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
    for f in range(d):
        rest = [g for g in range(d) if g != f]
        out.append(sum((value[tuple(sorted((*s, f)))] - value[s]) * math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) for k in range(d) for s in itertools.combinations(rest, k)))
    return out


def wide(values):
    out = {}
    for r in values.collect():
        out.setdefault(r["sample"], {})[r["feature"]] = r["shap_value"]
    return out


def test_boosted_classifier(spark, rows):
    model = inference.fit(rows, NAMES, "y", trees=4, depth=4)
    trees = explain.tree_table(spark, model.stages[-1])
    nodes = {(r["tree"], r["node"]): r for r in trees.collect()}
    got, base = wide(explain.shapley(rows, trees, "id", NAMES)), explain.expected_value(trees)
    margins = {r["id"]: r["m"] / 2 for r in model.transform(rows).select("id", (F.get(vector_to_array("rawPrediction"), F.lit(1)) * 2).alias("m")).collect()}
    data = {r["id"]: [r[c] for c in NAMES] for r in rows.collect()}
    assert len(got) == 400 and max(len(v) for v in got.values()) == 4
    for k, v in got.items():
        assert sum(v.values()) + base == pytest.approx(margins[k], abs=1e-9)
        if k < 40:
            assert [v[c] for c in NAMES] == pytest.approx(by_sets(nodes, data[k]), abs=1e-9)


@pytest.mark.parametrize("kind", [GBTRegressor, RandomForestRegressor])
def test_regressors_add_up(spark, rows, kind):
    learner = kind(labelCol="y", maxDepth=4, seed=5, **({"maxIter": 3} if kind is GBTRegressor else {"numTrees": 4}))
    made = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = learner.fit(made)
    trees = explain.tree_table(spark, model)
    share = 1 / 4 if kind is RandomForestRegressor else 1
    got, base = wide(explain.shapley(rows, trees, "id", NAMES)), explain.expected_value(trees)
    for r in model.transform(made).select("id", "prediction").collect():
        assert share * (sum(got[r["id"]].values()) + base) == pytest.approx(r["prediction"], abs=1e-9)


def test_single_trees_have_a_table(spark, rows):
    made = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    trees = explain.tree_table(spark, DecisionTreeClassifier(labelCol="y", maxDepth=2, seed=1).fit(made))
    assert trees.where("node = 0").first()["cover"] == 400


def test_nulls_repeats_infinities_and_empty_tables(spark):
    nodes = [(0, 0, 0, 1.0, 1, 2, 10.0, None), (0, 1, None, None, -1, -1, 4.0, 5.0), (0, 2, 0, 3.0, 3, 4, 6.0, None), (0, 3, None, None, -1, -1, 2.0, -1.0), (0, 4, None, None, -1, -1, 4.0, 7.0), (1, 0, None, None, -1, -1, 3.0, 0.5)]
    trees = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, cover double, value double")
    base = explain.expected_value(trees)
    assert base == pytest.approx(0.4 * 5 - 0.2 + 0.4 * 7 + 0.5)
    data = [(1, None), (2, float("-inf")), (3, float("inf")), (4, 1.0), (5, 3.0), (5, 3.0), (None, 2.0)]
    df = spark.createDataFrame(data, "k long, v double")
    got = sorted(((r["sample"] is None, r["sample"] or 0), round(r["shap_value"] + base, 9)) for r in explain.shapley(df, trees, "k", ["v"]).collect())
    assert [v for _, v in got] == [7.5, 5.5, 7.5, 5.5, -0.5, -0.5, -0.5]
    assert explain.shapley(df.limit(0), trees, "k", ["v"]).count() == 0


def test_stored_models_score_as_the_models(spark, rows, tmp_path):
    model = inference.fit(rows.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a"))), NAMES, "y", trees=3)
    inference.store(spark, str(tmp_path / "m"), model, NAMES, "y")
    new = rows.select("d", "c", "b", F.when(F.col("id") % 5 != 0, F.col("a")).alias("a"), "id", F.lit(1).alias("features"))
    got = {r["id"]: r for r in inference.score(new, str(tmp_path / "m"), ["id"]).collect()}
    want = model.transform(new.drop("features")).select("id", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()
    assert len(got) == len(want) == 400
    for r in want:
        assert got[r["id"]]["proxy_probability"] == pytest.approx(r["p"], abs=5.1e-5) and got[r["id"]]["predicted_proxy_label"] == r["prediction"]
    assert got[0]["target"] == "y"
    with pytest.raises(ValueError, match="missing columns: d"):
        inference.score(new.drop("d"), str(tmp_path / "m"), ["id"])


def test_nonempty_lines(spark):
    files = [("a/A.java", "\n package p.q ;\nclass A {\n\n}\r\n  \n"), ("target/B.java", "package p.q;\nx"), ("b/C.java", "no package"), ("D.java", None), ("e/E.java", "")]
    got = dict(map(tuple, inference.nonempty_lines(spark.createDataFrame(files, "path string, text string")).collect()))
    assert got == {"p.q": 3, "": 1}

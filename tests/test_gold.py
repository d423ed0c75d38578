import pytest

from millrace.operators import gold, metrics

LAYERS = {"UC": "requirement", "Java": "code", "Doc": "design"}
ROWS = [("R1", "UC", " pay  by\ncard ", 1), ("R1", "UC", "other", 2), ("R2", "UC", None, 3), ("C1", "Java", "\n  class A {\n  }\n", 4), ("D1", "Doc", "a  b", 5), ("D1", "Doc", "a  b", 6)]
TRACES = [("R1", "C1", 1), ("R1", "C1", 1), ("R1", "D1", 0), ("R2", "D1", 1), ("R9", "C1", 0)]


def frames(spark, traces=TRACES):
    found = gold.artifacts(spark.createDataFrame(ROWS, "id string, layer string, content string, place int"), LAYERS)
    return found, gold.true_links(found, spark.createDataFrame(traces, "source_id string, target_id string, label int"))


def test_artifacts_and_links(spark):
    found, links = frames(spark)
    assert {r["id"]: (r["type"], r["text"]) for r in found.collect()} == {"R1": ("requirement", "pay by card"), "R2": ("requirement", ""), "C1": ("code", "class A {\n  }"), "D1": ("design", "a b")}
    assert {tuple(r) for r in links.collect()} == {("R1", "C1", "requirement_to_code"), ("R2", "D1", "requirement_to_design")} and links.count() == 2
    assert [tuple(r) for r in gold.artifact_conflicts(spark.createDataFrame(ROWS, "id string, layer string, content string, place int")).collect()] == [("R1", 2)]
    assert tuple(gold.classes(found, links).first()) == (2, 2, 4, 2, 2, 2)


@pytest.mark.parametrize("trace, error", [(("R1", "X", 1), "unknown artifact: R1 -> X"), (("C1", "D1", 1), "unexpected layers"), (("R1", "R2", 1), "unexpected layers")])
def test_bad_traces_are_errors(spark, trace, error):
    with pytest.raises(Exception, match=error):
        frames(spark, [trace])[1].collect()


def test_unknown_layers_are_errors(spark):
    for layer in ("X", None):
        with pytest.raises(Exception, match="Unknown layer"):
            gold.artifacts(spark.createDataFrame([("a", layer, "t", 1)], "id string, layer string, content string, place int"), LAYERS).collect()


def test_metrics_equal_those_over_all_pairs(spark):
    found, links = frames(spark)
    predicted = spark.createDataFrame([("R1", "C1"), ("R1", "C1"), ("R1", "D1"), ("R2", "C1"), ("R7", "C1"), ("R1", "R2"), ("C1", "D1")], "source_id string, target_id string")
    true = {tuple(r)[:2] for r in links.collect()}
    pairs = [(s, t, int((s, t) in true)) for s in ("R1", "R2") for t in ("C1", "D1")]
    whole = metrics.link_metrics(predicted, spark.createDataFrame(pairs, "source_id string, target_id string, label int"), ["source_id", "target_id"]).first()
    got = gold.link_metrics(predicted, found, links).first()
    assert {k: got[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")} == {k: whole[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")}
    assert got["tn"] == 0 and tuple(gold.recall_ceiling(predicted, links).first()) == (2, 1, 0.5)
    nothing = gold.link_metrics(predicted.limit(0), found, links).first()
    assert (nothing["tp"], nothing["fp"], nothing["fn"], nothing["tn"], nothing["f1"]) == (0, 0, 2, 2, 0.0)

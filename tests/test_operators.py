"""Small fixtures worked out by hand, one for each branch of a rule."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.functions.columns import finite, mean_of, require, symmetric_change, truthy
from millrace.operators import architecture, corpus, evolution, graph, metrics, qa, similarity, trace


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def edges(spark, *pairs):
    return frame(spark, list(pairs), "src string, dst string")


def nodes(spark, names):
    return frame(spark, [(n,) for n in names], "node string")


def test_path_betweenness_and_pagerank(spark):
    path = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    got = {r.node: round(r.betweenness, 6) for r in graph.betweenness(nodes(spark, "abcd"), path).collect()}
    assert got == {"a": 0.0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0.0}
    ranks = {r.node: r.rank for r in graph.pagerank(nodes(spark, "abcd"), path).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["a"]


def test_components_and_cycles(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("a", "a"))
    weak = {r.node: r.component_id for r in graph.weak_components(nodes(spark, "abcdefg"), g).collect()}
    assert weak == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1, "f": 1, "g": 2}
    found = graph.cycles(nodes(spark, "abcdefg"), g).collect()
    assert [tuple(r) for r in found] == [("a;b;c", 3, 3)]
    assert graph.betweenness(nodes(spark, "ab"), edges(spark, ("a", "b"))).agg(F.sum("betweenness")).first()[0] == 0
    none = graph.degrees(nodes(spark, "ab"), g.limit(0)).collect()
    assert {(r.fan_in, r.fan_out, r.instability) for r in none} == {(0, 0, 0.0)}


def test_percentile_rank_shares_ties(spark):
    rows = frame(spark, [(1,), (1,), (3,), (5,), (None,)], "v int")
    got = [r.p for r in architecture.percentile_rank(rows, "v", "p").orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got == [0.375, 0.375, 0.75, 1.0, None]


def test_longest_prefix(spark):
    rules = frame(spark, [("a", "top"), ("a.b", "deep")], "prefix string, layer string")
    rows = frame(spark, [(1, "a.b.c"), (2, "a.x"), (3, "ab.c")], "id int, path string")
    assert {r.id: r.layer for r in architecture.longest_prefix(rows, "id", "path", rules).collect()} == {1: "deep", 2: "top", 3: None}


def test_scope_audit_classes(spark):
    rows = edges(spark, ("a", "b"), ("a", "b"), ("a", "a"), (" ", "b"), (None, "b"), ("a", "z"))
    got = architecture.scope_audit(rows, nodes(spark, "ab")).first()
    assert (got.blank_rows, got.self_rows, got.outside_rows, got.accepted_edges) == (2, 1, 1, 1)


def test_changes(spark):
    assert one(spark, symmetric_change(F.lit(1.0), F.lit(3.0))) == 0.5
    assert one(spark, symmetric_change(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, symmetric_change(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert one(spark, mean_of([F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)])) == 1.5
    snaps = frame(spark, [("r", 1, "a", 10), ("r", 2, "a", 30), ("r", 1, "b", 1), ("r", 2, "c", 1)], "repository string, year int, package string, files int")
    pairs = evolution.snapshot_pairs(snaps, ["repository"], "year")
    got = {r.package: (r.change_status, r.files_delta) for r in evolution.package_changes(snaps, pairs, ["repository"], "package", "year", ["files"]).collect()}
    assert got == {"a": ("retained", 20), "b": ("removed", None), "c": ("added", None)}


def test_column_helpers(spark):
    assert one(spark, truthy(F.lit(" Yes "))) and not one(spark, truthy(F.lit("no")))
    assert one(spark, finite(F.lit("1.5"))) == 1.5 and one(spark, finite(F.lit("x"))) is None and one(spark, finite(F.lit("NaN"))) is None
    with pytest.raises(ValueError, match="b"):
        require(spark.range(1), "id", "b")


def test_text_functions(spark):
    assert one(spark, F.array_join(fn.identifier_words(F.lit("addPatientRecord XMLParser a_b for x1")), " ")) == "add patient record xml parser"
    assert one(spark, fn.strip_boilerplate(F.lit("/* Copyright me */\nimport a.b;\nclass A {}\n"))).strip() == "class A {}"
    assert one(spark, fn.strip_boilerplate(F.lit("/** doc */\nclass A {}"))) == "/** doc */\nclass A {}"
    assert one(spark, fn.chunks(F.lit("a b c d e"), 4)) == ["a b c d", "d e"]
    assert one(spark, fn.chunks(F.lit("a b"), 4)) == ["a b"]
    assert one(spark, fn.sentences(F.lit("One. Two! three? Four"))) == ["One.", "Two! three?", "Four"]
    assert one(spark, fn.package_name(F.lit("// x\npackage a.b ;\n"))) == "a.b"
    source = "import a.B;\nimport static c.D.e;\nimport f.*;\n"
    assert one(spark, fn.imports(F.lit(source))) == ["a.B"]
    assert one(spark, fn.imports(F.lit(source), static=True, wildcard=True)) == ["a.B", "c.D.e", "f.*"]
    assert one(spark, fn.declared_types(F.lit("class A {} interface B {} enum A {}"))) == ["A", "B"]
    assert one(spark, fn.package_of_path(F.lit("x/src/main/java/org/a/B.java"))) == "org.a"
    assert one(spark, fn.package_of_path(F.lit("src/B.java"))) == "default"
    assert one(spark, fn.package_of_path(F.lit("lib/B.java"))) == "unresolved"
    assert one(spark, fn.behaviour(F.lit("It shall REJECT exactly five"))) == "NEGATIVE"
    assert one(spark, fn.constraints(F.lit("within 2 seconds, p95, 2 seconds, 30 %x"))) == ["p95", "30 %", "2 seconds"]
    assert one(spark, fn.grounded(F.lit("the quick brown ... jumps over it"), F.lit("The Quick-Brown fox jumps over it all")))
    assert not one(spark, fn.grounded(F.lit("the quick green"), F.lit("the quick brown")))
    assert one(spark, fn.weak_words(F.lit("As soon as possible"), ["as", "soon as"])[1]) == "as"


def test_atomic_parts(spark):
    parts = lambda t: one(spark, fn.atomic_parts(F.lit(t), ["shall", "must"], ["notify", "log"]))
    two = parts("The system shall lock the account and notify the user.")
    assert [p.text for p in two] == ["The system shall lock the account.", "The system shall notify the user."]
    assert [p.confidence for p in two] == [0.92, 0.88]
    assert [p.confidence for p in parts("The system shall lock and key it")] == [0.96]
    assert parts("No verb here")[0].review == "no modal verb"


def test_corpus_rules(spark):
    rows = frame(spark, [(1, "k", "train"), (2, "k", "test"), (3, "m", "test"), (4, "m", "validation"), (5, "n", "validation")], "id int, key string, split string")
    assert sorted(r.id for r in corpus.remove_leakage(rows, "key", "split").collect()) == [1, 3, 5]
    first = corpus.first_per_key(rows, ["key"], [F.col("split"), F.col("id")]).collect()
    assert {r.key: r.id for r in first} == {"k": 2, "m": 3, "n": 5}
    runs = frame(spark, [("u", i, b) for i, b in enumerate([True, True, False, True])], "u string, i int, bad boolean")
    assert [r.bad_run for r in corpus.run_lengths(runs, ["u"], "i", F.col("bad")).orderBy("i").collect()] == [1, 2, 0, 1]


EVIDENCE = "rvu_id int, evidence_id int, evidence_type string, relevance double, precondition double, input double, condition double, scenario double, outcome double, oracle double, execution_status string, synthetic boolean, explicitly_observed boolean"


def test_adequacy_and_validation_ladder(spark):
    full = (1.0,) * 6
    rows = [
        (1, 1, "AUTOMATED_TEST", 0.9, *full, "PASS", False, None),
        (2, 2, "AUTOMATED_TEST", 0.9, *full, "PASS", True, None),
        (3, 3, "AUTOMATED_TEST", 0.9, *full, "PASS", False, False),
        (4, 4, "MANUAL_TEST", 0.9, *full[:5], 0.2, "FAIL", False, None),
        (5, 5, "PERFORMANCE", 0.9, *full, "PASS", False, None),
        (6, 6, "AUTOMATED_TEST", 0.2, *full, "PASS", False, None),
        (7, 7, "AUTOMATED_TEST", 0.9, *full, "PASS", False, None),
        (8, 8, "AUTOMATED_TEST", 0.9, *full, "PASS", False, None),
    ]
    assessed = qa.assess(frame(spark, rows, EVIDENCE))
    status = {r.evidence_id: r.adequacy_status for r in assessed.collect()}
    assert status == {1: "ADEQUATE", 2: "ADEQUATE", 3: "ADEQUATE", 4: "PARTIAL", 5: "INADEQUATE", 6: "INADEQUATE", 7: "ADEQUATE", 8: "ADEQUATE"}
    support = {7: "UNSUPPORTED", 8: "REVIEW_REQUIRED"}
    units = frame(spark, [(i, 1 if i < 7 else 2, support.get(i, "SUPPORTED")) for i in range(1, 10)], "rvu_id int, requirement_id int, support_status string")
    checked = qa.validate(qa.summarize(units, assessed), qa.satisfied(assessed))
    got = {r.rvu_id: r.validation_status for r in checked.collect()}
    assert got == {1: "VALIDATED", 2: "PARTIAL", 3: "PARTIAL", 4: "PARTIAL", 5: "UNSATISFIED", 6: "UNSATISFIED", 7: "NOT_ASSESSED", 8: "NOT_ASSESSED", 9: "UNSATISFIED"}
    kinds = {r.rvu_id: r.gap_type for r in qa.gaps(checked).collect()}
    assert kinds == {2: "FAILED_OR_UNEXECUTED", 3: "FAILED_OR_UNEXECUTED", 4: "PARTIAL_EVIDENCE", 5: "INADEQUATE_EVIDENCE", 6: "MISSING_EVIDENCE", 7: "SPECIALIZED_REVIEW_REQUIRED", 8: "SPECIALIZED_REVIEW_REQUIRED", 9: "MISSING_EVIDENCE"}
    assert {r.requirement_id: r.status for r in qa.roll_up(checked).collect()} == {1: "PARTIAL", 2: "INADEQUATE"}


def test_revalidation_classes(spark):
    rows = [(None, "a", "b", ["1"], ["2"], False, False), (1, "a", " A", ["1"], ["2"], False, False), (2, "a", "b", ["1"], ["2"], True, True), (3, "a", "b", ["1"], ["2"], False, True), (4, "a", "b", ["1"], ["1"], True, True)]
    cases = frame(spark, rows, "evidence_id int, old_purpose string, new_purpose string, old_constraints array<string>, new_constraints array<string>, is_boundary boolean, names_old boolean")
    got = [r.classification for r in qa.revalidation(cases).orderBy(F.col("evidence_id").asc_nulls_first()).collect()]
    assert got == ["NEW_EVIDENCE_REQUIRED", "REUSABLE", "MODIFICATION_REQUIRED", "OUTDATED", "MODIFICATION_REQUIRED"]


def test_links(spark):
    schema = "source_id string, target_id string, confidence double, status string, verified_at int, last_checked_at int"
    links = frame(spark, [("r1", "c1", 0.5, "decayed", 1, 1), ("r2", "c2", 0.5, "verified", 1, 1)], schema)
    new = frame(spark, [("r1", "c1", 0.9, 5), ("r3", "c3", 0.7, 5), ("r4", "gone", 0.7, 5)], "source_id string, target_id string, confidence double, at int")
    ids = frame(spark, [(i,) for i in ("r1", "r2", "r3", "r4", "c1", "c2", "c3")], "id string")
    with pytest.raises(Exception, match="link without its ends: r4 -> gone"):
        trace.upsert(links, new, ids).collect()
    new, refused = trace.by_ends(new, ids)
    assert [tuple(r) for r in refused.select("source_id", "target_id", "missing").collect()] == [("r4", "gone", "target_id")]
    once = trace.upsert(links, new, ids)
    got = {r.source_id: (r.confidence, r.status, r.verified_at, r.last_checked_at) for r in once.collect()}
    assert got == {"r1": (0.9, "verified", 1, 5), "r2": (0.5, "verified", 1, 1), "r3": (0.7, "verified", 5, 5)}
    assert sorted(map(tuple, trace.upsert(once, new, ids).collect())) == sorted(map(tuple, once.collect()))
    marked, flags = trace.mark_decayed(once, frame(spark, [("r3", "c3", "changed", 8), ("no", "no", "changed", 8)], "source_id string, target_id string, reason string, at int"))
    assert marked.count() == 3 and [tuple(r) for r in flags.collect()] == [("r3", "c3", "changed", 8)]
    needs = frame(spark, [("r1", None), ("r2", 2.0), ("r3", 0.5), ("r9", None)], "id string, evidence double")
    score = {r.id: (r.completeness, r.orphan) for r in trace.completeness(needs, marked).collect()}
    assert score == {"r1": (90.0, False), "r2": (70.0, False), "r3": (20.0, True), "r9": (0.0, True)}


def test_percentiles(spark):
    import numpy as np

    values = np.random.default_rng(4).integers(0, 40, size=200).tolist()
    rows = frame(spark, [(k % 3, float(v)) for k, v in enumerate(values)] + [(1, None), (9, None)], "g int, v double")
    got = {r.g: (r.p50, r.p95, r.p10) for r in metrics.percentiles(rows, "v", ["g"], (50, 95, 10)).collect()}
    assert got.pop(9) == (None, None, None)
    assert got == {g: pytest.approx(tuple(np.percentile(values[g::3], [50, 95, 10]))) for g in range(3)}
    assert metrics.percentiles(rows.limit(0), "v").first().p50 is None


def test_metrics(spark):
    gold = frame(spark, [("a", "x", 1), ("a", "y", 0), ("b", "x", 1)], "s string, t string, label int")
    said = frame(spark, [("a", "x"), ("a", "y"), ("q", "q")], "s string, t string")
    r = metrics.link_metrics(said, gold, ["s", "t"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)
    assert metrics.link_metrics(said.limit(0), gold, ["s", "t"]).first().f1 == 0.0
    same = frame(spark, [(1, 1), (1, 1)], "a int, b int")
    assert metrics.kappa(same, "a", "b").first().kappa == 1.0
    assert metrics.kappa(same.limit(1), "a", "b").first().kappa is None
    assert one(spark, metrics.set_f1(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0


def test_zscore_fusion_prefers_agreement(spark):
    s = "query int, target int, score double"
    a, b = frame(spark, [(1, 1, 0.9), (1, 2, 0.8)], s), frame(spark, [(1, 1, 0.5), (1, 3, 0.6)], s)
    assert [r.target for r in similarity.top_k(similarity.fuse([a, b], 10), 3).orderBy("rank").collect()][0] == 1


def test_dense_similarity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rows = [(i, [1.0, i / 10]) for i in range(8)] + [(8, [0.0, 0.0])]
    table = frame(spark, rows, "id long, vector array<double>")
    pairs = {(r.left, r.right) for r in similarity.similarity_join(table, 0.99).collect()}
    cos = lambda x, y: (1 + x * y / 100) / ((1 + x * x / 100) ** 0.5 * (1 + y * y / 100) ** 0.5)
    assert pairs == {(x, y) for x in range(8) for y in range(x + 1, 8) if cos(x, y) >= 0.99 - 1e-7}
    best = {(r.query, r.rank): r.target for r in similarity.vector_top_k(table, table.where("id in (0, 3, 7)"), 1).collect()}
    assert best == {(0, 1): 1, (3, 1): 2, (7, 1): 6} or best[(3, 1)] in (2, 4)

"""Scores of pairs: what is shuffled for them, and that rows sent to all tasks and rows that are not give the same."""

import re

from millrace.operators import similarity

TEXTS = [(1, "The pump shall stop at 80 degrees. x"), (2, "A pump stops; the valve shall close and the pump shall stop"), (3, "Catering invoice of the archive"), (4, ""), (5, None), (6, "valve valve valve close at 80")]
ASKED = [(1, "when shall the pump stop"), (2, "valve close"), (3, "nothing here fits"), (4, None)]


def frames(spark):
    return tuple(spark.createDataFrame(rows, "id long, text string") for rows in (ASKED, TEXTS))


def dealt_by(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def scores(df):
    return {(r.query, r.target): round(r.score, 9) for r in df.collect()}


def test_pairs_are_not_shuffled_for_scores(spark):
    q, t = frames(spark)
    keyword, tfidf = similarity.keyword_scores(q, t), similarity.tfidf_scores(q, t)
    for found in (keyword, tfidf, similarity.fuse([keyword, tfidf], len(TEXTS))):
        assert dealt_by(found) and not [x for x in dealt_by(found) if "query#" in x and "target#" in x or x.startswith("w#")]


def test_fused_scores_add_up(spark):
    q, t = frames(spark)
    methods = similarity.keyword_scores(q, t), similarity.tfidf_scores(q, t)
    each = [scores(similarity.zscores(m, len(TEXTS))) for m in methods]
    nothing = [{r.query: r.nothing for r in similarity.zscores(m, len(TEXTS)).collect()} for m in methods]
    want = {k: round(sum(z.get(k, n.get(k[0], 0)) for z, n in zip(each, nothing)), 6) for k in set(each[0]) | set(each[1])}
    assert {k: round(v, 6) for k, v in scores(similarity.fuse(methods, len(TEXTS))).items()} == want


def test_best_parts_stay_with_their_targets(spark):
    q, t = frames(spark)
    long = t.unionByName(spark.createDataFrame([(7, " ".join(["shall"] * 70 + ["pump"] * 70 + ["stop"]))], "id long, text string"))
    found = similarity.candidates(q, long, "keyword", 3)
    assert not [x for x in dealt_by(found) if "part#" in x or "target#" in x and "query#" in x]
    best = {(r.query, r.rank): (r.target, r.score) for r in found.collect()}
    assert best[1, 3] == (7, 0.4) and best[2, 1] == (6, 0.5)  # parts of 7: {shall}, {shall, pump}, {pump, stop}
    assert similarity.candidates(q, long.limit(0), "hybrid", 3).count() == 0


def test_terms_beyond_what_is_sent_to_all_tasks(spark, monkeypatch):
    q, t = frames(spark)
    near = scores(similarity.tfidf_scores(q, t)), scores(similarity.keyword_scores(q, t)), scores(similarity.candidates(q, t, "hybrid", 9, chunk=3))
    monkeypatch.setattr(similarity, "HELD", 3)
    assert near[0] and near == (scores(similarity.tfidf_scores(q, t)), scores(similarity.keyword_scores(q, t)), scores(similarity.candidates(q, t, "hybrid", 9, chunk=3)))
    weights = similarity.term_weights(t.selectExpr("'t' AS side", "*").unionByName(q.selectExpr("'q' AS side", "*")))
    a, b = ({(r.id, r.term): r.weight for r in weights.where(f"side = '{s}'").collect()} for s in "qt")
    want = {}
    for (x, term), w in a.items():
        for (y, other), v in b.items():
            if term == other:
                want[x, y] = want.get((x, y), 0) + w * v
    assert {k: round(v, 9) for k, v in want.items()} == near[0]


def test_vectors_are_not_copied_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(40)]
    found = similarity.similarity_join(spark.createDataFrame(rows, "id long, vector array<float>"), 0.95)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "explode" not in plan
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    want = {(a, b) for a in unit for b in unit if a < b and sum(x * y for x, y in zip(unit[a], unit[b])) >= 0.95 - 1e-7}
    got = [(r.left, r.right) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want

import corpus_pipeline
from millrace.llm import decontaminate, mixing
from tests.llm.test_simhash import alike_components

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "shards"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "shards":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
    before, after = seen["near_duplicates"]
    groups = alike_components({r.doc_id: r.text for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))
    before, after = seen["benchmark"]
    items = [b" " + b" ".join(decontaminate.fold(r.text)) + b" " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in before if any(i in b" " + b" ".join(decontaminate.fold(r.text)) + b" " for i in items)}
    assert holds and not holds & {r.doc_id for r in after}
    assert len(before) - len(after) <= len(holds) + 1
    before, after = seen["mix"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    goal = sum(len((r.text or "").split()) for r in before)
    assert abs(sum(len((r.text or "").split()) for r in after) - goal) < 0.25 * goal
    before, after = seen["shards"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "shard", "shard_rows", "shard_bytes", "version"] and out.count() > 0
    assert mixing.CAP == 3


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "alpha beta gamma delta", None, None), (None, "alpha beta gamma delta", None, None), (4, "long words " * 60000, "en", "a"), (5, "123 !", "fr", "c"), (6, "abc", "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key int, shard int, doc int")


def test_odd_documents_in_every_stage(spark):
    docs = odd_documents(spark)
    kept = {"language": [-1, -1, 1, 1, 4, 6], "near_duplicates": [-1, 1, 2, 4, 5, 6], "benchmark": [-1, -1, 1, 1, 2, 3, 4, 5, 6]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "shards":
            assert out.columns == docs.columns
        ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
        if name in kept:
            assert ids == kept[name], name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert len(ids) == docs.count()

import pytest

from millrace.llm import sharding as d


def store(spark, tmp_path, **options):
    return d.Store(spark, str(tmp_path / "store"), **options)


def rows(spark, start, n):
    return spark.range(start, start + n).selectExpr("id AS doc_id", "repeat(md5(cast(id AS string)), 40) AS text", "'x' AS shard").coalesce(1)


def test_appends_merges_and_versions(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=1 << 20, fanout=3, floor_bytes=1 << 12)
    assert s.version() == 0 and s.manifest().isEmpty()
    for k in range(5):
        s.append(rows(spark, 100 * k, 100).drop("shard"))
    before = s.version()
    assert before == 5 and s.manifest().count() == 5
    s.compact(expire=False)
    assert s.version() > before and s.manifest().count() < 3
    for version in (before, s.version()):
        assert sorted(r.doc_id for r in s.read(version).select("doc_id").collect()) == list(range(500))
    assert s.manifest().agg({"rows": "sum"}).first()[0] == 500
    assert {r.since for r in s.manifest().collect()} == {s.version()} or s.manifest().count() > 1


def test_a_taken_version_is_tried_anew(spark, tmp_path):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(rows(spark, 0, 10).drop("shard"))
    seen = iter([0])  # what the other writer read before the first one committed
    real = other.version
    other.version = lambda: next(seen, None) if seen.__length_hint__() else real()
    other.append(rows(spark, 10, 10).drop("shard"))
    assert s.version() == 2 and s.read().count() == 20


def test_an_unfinished_write_is_in_no_version(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, 0, 10).drop("shard"))
    s._written(rows(spark, 10, 10).drop("shard"))
    assert s.read().count() == 10
    with pytest.raises(ValueError):
        store(spark, tmp_path / "new").read()


def test_every_row_lies_in_one_shard(spark, tmp_path):
    table = spark.createDataFrame([(i % 40 if i % 9 else None, None if i % 5 == 0 else "t" * (i * 50), "s", i) for i in range(300)], "doc_id long, text string, shard string, version int")
    table.repartition(9).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    got = d.shard(plain, fanout=3, floor_bytes=1 << 10, target_bytes=1 << 16).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r.doc_id is None, r.doc_id) for r in plain.collect())
    sizes = {}
    for r in got:
        sizes.setdefault((r.shard, r.shard_rows), []).append(r.doc_id)
    assert all(len(found) == n for (_, n), found in sizes.items())
    assert d.shard(plain.limit(0)).count() == 0
    few = plain.where("version < 10").select("doc_id", "text")
    assert sorted(r.doc_id or -1 for r in d.shard(few).collect()) == sorted(r.doc_id or -1 for r in few.collect())

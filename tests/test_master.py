"""Fates on hand-made rows, models a label, databases and evidence files."""

import json

from pyspark.sql import functions as F

from millrace.operators import corpus, learn, master
from millrace.sources import readers

SCHEMA = "id long, source string, text string, label string"
SIX = "the system shall keep all records"


def told(spark, rows, canonical=None, least=6):
    return {r.id: r for r in master.fates(spark.createDataFrame(rows, SCHEMA), canonical or {}, least).collect()}


def test_every_fate(spark):
    got = told(
        spark,
        [(1, "main", SIX, "F"), (2, "main", f" {SIX.upper()}", "F"), (3, "copy", SIX + ".", "N"), (4, "main", "One two", "F"), (5, "main", "one  two", "N"), (6, None, None, "F"), (7, "copy", "?!", None), (8, "copy", "only here", None)],
        {"copy": "main"},
    )
    assert {i: r.fate for i, r in got.items()} == {1: "master", 2: "dup_dropped", 3: "collapsed", 4: "conflict_moved", 5: "conflict_moved", 6: "dropped_empty", 7: "dropped_empty", 8: "master"}
    assert (got[1].copies, got[1].also_in, got[1].conflict) == (2, "copy", "cross_source")
    assert (got[8].copies, got[8].also_in, got[8].conflict, got[3].copies) == (1, None, None, None)


def test_short_texts_and_missing_labels_make_no_conflict(spark):
    got = told(spark, [(1, "a", "one two", "F"), (2, "b", "one two", "N"), (3, "a", SIX, None), (4, "b", SIX, "N")])
    assert {r.fate for r in got.values()} == {"master"} and {r.conflict for r in got.values()} == {None}


def test_a_missing_label_beside_one_is_a_conflict_within(spark):
    got = told(spark, [(1, "a", SIX, "F"), (2, "a", SIX, None), (3, "b", SIX, "F")])
    assert [got[i].fate for i in (1, 2, 3)] == ["conflict_moved", "conflict_moved", "master"] and got[3].conflict == "within_source"


def test_no_rows(spark):
    assert told(spark, []) == {}


def test_report_counts_each_row_once(spark):
    rows = spark.createDataFrame([(1, "a", SIX, "F"), (2, "a", SIX, "F"), (3, "b", "", "F")], SCHEMA)
    got = {r.source: r.asDict() for r in master.fate_report(master.fates(rows, {})).collect()}
    assert got["a"] == {"source": "a", "rows_in": 2, "master": 1, "collapsed": 0, "dup_dropped": 1, "conflict_moved": 0, "dropped_empty": 0}
    assert got["b"]["dropped_empty"] == 1


def test_one_model_a_label(spark):
    texts = [(f"{a} {b} number", int(a == "fast"), int(b == "secret") if k else None) for k in range(6) for a in ("fast", "slow") for b in ("secret", "open")]
    rows = spark.createDataFrame(texts, "text string, speed int, secrecy int")
    got = learn.labels_of(learn.one_vs_rest(rows, ["speed", "secrecy"]), rows).collect()
    assert all(r.speed_pred == r.speed and r.secrecy_pred == int("secret" in r.text) for r in got) and len(got) == len(texts)


def test_database_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.col("id").cast("int").alias("NUMBER_"), F.concat(F.lit("c"), "id").alias("NAME_"))
    rows.write.format("jdbc").options(url=url, dbtable="CHANGES", createTableColumnTypes="NAME_ VARCHAR(20)", **driver).save()
    whole = readers.database(spark, url, "CHANGES", **driver)
    ranged = readers.database(spark, url, "CHANGES", "NUMBER_", 4, **driver)
    assert sorted(whole.collect()) == sorted(ranged.collect()) == sorted(rows.collect()) and ranged.rdd.getNumPartitions() == 4


def test_evidence_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"evidence_id": "m1", "title": "t", "steps": ["a", "b"]}, {"title": "no id", "synthetic": True}]))
    (tmp_path / "p.json").write_text(json.dumps([{"evidence_id": "p1", "title": "t", "measured_value": 1.5, "threshold": 2, "configuration": {"users": 5}}]))
    manual = readers.evidence(spark, str(tmp_path / "m.json"), "MANUAL_TEST")
    measured = readers.evidence(spark, str(tmp_path / "p.json"), "PERFORMANCE_EVIDENCE")
    assert manual.columns == measured.columns
    got = {r.title + str(r.evidence_id): r for r in manual.unionByName(measured).collect()}
    m, p, none = got["tm1"], got["tp1"], got["no idNone"]
    assert (m.steps, m.inputs, m.synthetic, m.source_tool, m.description, m.metric) == (["a", "b"], [], False, "C3_MANUAL_CURATED", "", None)
    assert (p.measured_value, p.threshold, p.configuration, p.synthetic, p.steps, p.evidence_type) == (1.5, 2.0, {"users": "5"}, True, None, "PERFORMANCE_EVIDENCE")
    assert none.synthetic and none.raw_reference is None and m.source_path.endswith("m.json")


def test_quota_with_null_strata_and_without_luck(spark):
    rows = spark.createDataFrame([(i, (None, "a", "b")[i % 3] if i else "rare") for i in range(300)], "id long, part string")
    whole = {p: sorted((r.order_key, r.id) for r in rows.withColumn("order_key", corpus.hash_order("s", F.col("id"))).where(F.col("part").eqNullSafe(p)).collect())[:5] for p in (None, "a", "b", "rare")}
    for margin in (10.0, -1.2):  # the second margin leaves every stratum but the rare one short of its quota or close to it
        got = corpus.quota_sample(rows, "s", "id", "part", 5, margin).collect()
        assert {p: sorted((r.order_key, r.id) for r in got if r.part == p) for p in whole} == whole

"""Texts are normalised once, and their digests are what moves."""

from pyspark.sql import functions as F

from millrace.operators import master, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fates_move_digests(spark):
    rows = spark.createDataFrame([(1, "s", "One two.", "x"), (2, "s", "one  TWO", "x"), (3, "t", "one two", "x"), (4, "t", "...", "x"), (5, None, None, None)], "id long, source string, text string, label string")
    found = master.fates(rows, {"t": "s"}, 1)
    assert "regexp_replace" not in plan(found)
    assert {r.id: (r.fate, r.also_in) for r in found.collect()} == {1: ("master", "t"), 2: ("master", "t"), 3: ("collapsed", None), 4: ("dropped_empty", None), 5: ("dropped_empty", None)}


def test_related_pairs_move_digests(spark):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e. F"), (3, "g h i j k l"), (4, "short"), (5, "m n o p q r")], "id long, text string")
    known = texts.where("id < 5").select(F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("text_key"))
    relations = spark.createDataFrame([("p", 1, 3), ("q", 2, 3), ("p", 1, 4), ("p", 1, 5), ("p", 1, 9)], "project string, left long, right long")
    found = splits.related_pairs(relations, texts, known, spark.createDataFrame([("p", "train"), ("q", "test")], "project string, split string"))
    assert "regexp_replace" not in plan(found)
    rows = {(r.left, r.right): r for r in found.collect()}
    assert {k: r.dropped for k, r in rows.items()} == {(1, 3): None, (2, 3): "text_in_train", (1, 4): "short_text", (1, 5): "not_in_master", (1, 9): "text_missing"}
    assert rows[1, 3].left_key == rows[2, 3].left_key != rows[1, 3].right_key and rows[1, 9].right_key is None

"""Corpus operators over documents and their labels; equal texts are equal keys of letters and digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.operators import corpus, selection
from millrace.plans.registry import Catalog, read

catalog = Catalog()
KEYED = "k AS (SELECT doc_id, lang, source, n_chars, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS text_key FROM documents)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(fn.text_key(F.col("text")).cast("binary")).alias("text_key"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = KEYED + ", l AS (SELECT k.*, quality, toxic FROM k LEFT JOIN labels USING (doc_id))"


@catalog.add(f"WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY source, doc_id) AS n FROM k), a AS (SELECT text_key, string_agg(DISTINCT source, ';' ORDER BY source) AS also_in, count(*) AS copies FROM k GROUP BY 1) SELECT doc_id, source, also_in, copies FROM r JOIN a USING (text_key) WHERE n = 1")
def first_per_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir)
    first = corpus.first_per_key(rows, ["text_key"], [F.col("source"), F.col("doc_id")])
    return first.join(corpus.also_in(rows, ["text_key"], "source"), "text_key").select("doc_id", "source", "also_in", "copies")


@catalog.add(f"WITH {LABELLED} SELECT text_key, count(DISTINCT doc_id % 3) AS labels, count(DISTINCT source) AS sources, count(*) AS rows FROM l GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1 AND count(DISTINCT source) >= 2")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.conflicts(labelled(spark, sf_dir).withColumn("verdict", F.col("doc_id") % 3), "text_key", "source", "verdict", across=True)


@catalog.add(f"WITH {LABELLED} SELECT lang, source, count(DISTINCT quality) AS labels, 1::BIGINT AS sources, count(*) AS rows FROM l WHERE quality IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT quality) > 1")
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.conflicts(labelled(spark, sf_dir), "lang", "source", "quality", across=False)


@catalog.add(
    f"""WITH {LABELLED}, u AS (SELECT text_key, source, 'quality' AS category, quality AS value FROM l UNION ALL SELECT text_key, source, 'toxic', toxic FROM l)
SELECT text_key, category, count(DISTINCT source) AS sources, count(DISTINCT value) AS values, count(DISTINCT source) >= 2 AND count(DISTINCT value) > 1 AS conflict FROM u WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def annotation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.annotation_conflicts(labelled(spark, sf_dir), "text_key", "source", ["quality", "toxic"])


@catalog.add('SELECT lang, count(*) FILTER (WHERE quality = 0) AS "0", count(*) FILTER (WHERE quality = 1) AS "1" FROM documents JOIN labels USING (doc_id) GROUP BY lang')
def crosstab_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.crosstab(labelled(spark, sf_dir).where("quality is not null"), "lang", "quality", [0, 1])


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END"


@catalog.add(
    f"""WITH {KEYED}, s AS (SELECT *, {_SPLIT} AS split FROM k), p AS (SELECT text_key, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM s GROUP BY 1)
SELECT doc_id, split FROM s JOIN p USING (text_key) WHERE NOT ((split <> 'train' AND tr) OR (split = 'validation' AND te))"""
)
def leakage_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("doc_id") % 10
    rows = keyed(spark, sf_dir).withColumn("split", F.when(part < 7, "train").when(part < 8, "validation").otherwise("test"))
    return corpus.remove_leakage(rows, "text_key", "split").select("doc_id", "split")


@catalog.add("SELECT doc_id, sha256('seed|' || doc_id) AS order_key FROM documents ORDER BY order_key, doc_id LIMIT 25")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.hash_sample(read(spark, sf_dir, "documents").select("doc_id"), "seed", "doc_id", 25)


@catalog.add("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed|' || doc_id), doc_id) AS n FROM documents) WHERE n <= 20")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "seed", "doc_id", "lang", 20).select("doc_id", "lang")


@catalog.add(f"WITH {KEYED} SELECT text_key, a.n AS left_rows, b.n AS right_rows FROM (SELECT text_key, count(*) AS n FROM k WHERE source < 'src15' GROUP BY 1) a JOIN (SELECT text_key, count(*) AS n FROM k WHERE source >= 'src15' GROUP BY 1) b USING (text_key)")
def corpus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir)
    return corpus.overlap(rows.where("source < 'src15'"), rows.where("source >= 'src15'"), "text_key")


@catalog.add("SELECT doc_id, 'left_only' AS side FROM documents WHERE n_chars > 2000 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000)")
def unmatched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.symmetric_difference(read(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@catalog.add(
    """SELECT 'duplicate_documents' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS failures UNION ALL
SELECT 'empty_text', (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') UNION ALL
SELECT 'orphan_labels', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
SELECT 'unlabelled', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL
SELECT 'wrong_size', (SELECT count(*) FROM documents WHERE n_chars <> length(text)) UNION ALL
SELECT 'orphan_lines', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL
SELECT 'turn_gaps', (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) <> max(turn) - min(turn) + 1))"""
)
def quality_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir).select("check", "failures")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), (F.max("turn") - F.min("turn") + 1).alias("m"))
    return corpus.gates(
        [
            ("duplicate_documents", docs.groupBy("doc_id").count().where("count > 1")),
            ("empty_text", docs.where("text is null or trim(text) = ''")),
            ("orphan_labels", labels.join(docs.select("doc_id"), "doc_id", "left_anti")),
            ("unlabelled", docs.select("doc_id").join(labels, "doc_id", "left_anti")),
            ("wrong_size", docs.where("n_chars <> length(text)")),
            ("orphan_lines", lines.select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
            ("turn_gaps", turns.where("n <> m")),
        ]
    )


@catalog.add("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, conv_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0') AS run_id FROM conversations")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.running_position(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    return rows.withColumn("position", F.col("position").cast("long")).withColumn("run_id", F.format_string("%d:%04d", "conv_id", F.col("position") + 1))


@catalog.add(
    """WITH b AS (SELECT user_id, event_id, value < 0.3 * (SELECT avg(value) FROM events) AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM b)
SELECT user_id, event_id, bad_run FROM (SELECT user_id, event_id, sum(bad::INT) OVER (PARTITION BY user_id, block ORDER BY event_id)::BIGINT AS bad_run FROM g) WHERE bad_run >= 3"""
)
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    mean = events.agg(F.avg("value").alias("mean"))
    rows = events.join(F.broadcast(mean)).withColumn("bad", F.col("value") < 0.3 * F.col("mean"))
    return corpus.run_lengths(rows, ["user_id"], "event_id", F.col("bad")).where("bad_run >= 3").select("user_id", "event_id", "bad_run")


@catalog.add(
    """SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT value) AS values, count(*) - count(json_extract_string(props, '$.k')) AS missing_k, min(event_id) AS first_event, max(ts) AS last_ts FROM events GROUP BY 1"""
)
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("value").alias("values"), F.count_if(k.isNull()).alias("missing_k"), F.min("event_id").alias("first_event"), F.max("ts").alias("last_ts")
    )


@catalog.add("SELECT lang, arg_min(source, (-n, source)) AS majority FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang".replace("arg_min(source, (-n, source))", "min_by(source, row(-n, source))"))
def majority_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("majority"))


_QUOTAS = (("system", 12), ("assistant", 25), ("user", 60))


@catalog.add(
    """WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS k, role, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^a-z0-9]', '', 'g') ORDER BY conv_id * 1000 + turn) AS copy
  FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) BETWEEN 6 AND 60 AND role IN ('system', 'assistant', 'user')),
o AS (SELECT k, role, toks, row_number() OVER (ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, sha256('pick|' || k)) AS i FROM w WHERE copy = 1),
g(i, picks) AS (SELECT 0::BIGINT, []::STRUCT(k BIGINT, role VARCHAR, toks VARCHAR[])[] UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(picks, lambda p: p.role = o.role)) < CASE o.role WHEN 'system' THEN 12 WHEN 'assistant' THEN 25 ELSE 60 + 12 - len(list_filter(picks, lambda p: p.role = 'system')) + 25 - len(list_filter(picks, lambda p: p.role = 'assistant')) END
    AND len(list_filter(picks, lambda p: len(list_intersect(p.toks, o.toks)) >= 0.18 * (len(p.toks) + len(o.toks) - len(list_intersect(p.toks, o.toks))) - 0.000000001)) = 0
    THEN list_append(picks, {'k': o.k, 'role': o.role, 'toks': o.toks}) ELSE picks END FROM g JOIN o ON o.i = g.i + 1),
e AS (SELECT unnest(picks) AS p FROM g WHERE i = (SELECT max(i) FROM g))
SELECT p.k AS k, p.role AS role FROM e"""
)
def stratified_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations by role; what the first two roles lack is made up by the last."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "role", "text")
    return selection.select_by_quota(turns, "k", "role", "text", _QUOTAS, "pick", 0.18, fallback="user").select("k", "role")

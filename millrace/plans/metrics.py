"""Labels are the gold standard; a rule on the text is the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.operators import corpus, gold
from millrace.operators import metrics as mx
from millrace.plans import similarity as looked
from millrace.plans.registry import Catalog, read

catalog = Catalog()
BAD = "clown|trash|worthless|scum"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.col("text").rlike(BAD).cast("int").alias("said"), (F.col("n_chars") < 3000).cast("int").alias("short"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


JUDGED = f"j AS (SELECT doc_id, lang, n_chars, regexp_matches(text, '{BAD}')::INT AS said, (n_chars < 3000)::INT AS short, quality, toxic FROM documents JOIN labels USING (doc_id))"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@catalog.add(f"WITH {JUDGED} SELECT toxic, said, count(*) AS count FROM j GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.confusion(judged(spark, sf_dir), "toxic", "said")


_PRF = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"
_RATED = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1"
CLASSES = f"""k AS (SELECT c AS class, count(*) FILTER (WHERE quality = c AND short = c) AS tp, count(*) FILTER (WHERE quality <> c AND short = c) AS fp, count(*) FILTER (WHERE quality = c AND short <> c) AS fn FROM j, (SELECT unnest([0, 1])::INT AS c) GROUP BY c),
q AS (SELECT *, {_PRF} FROM k)"""


@catalog.add(f"WITH {JUDGED}, {CLASSES} SELECT class, tp, fp, fn, tp + fn AS support, {_RATED} FROM q")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.class_metrics(judged(spark, sf_dir), "quality", "short"), "precision", "recall", "f1")


@catalog.add(f"WITH {JUDGED}, {CLASSES} SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS macro_f1 FROM q")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.summary(mx.class_metrics(judged(spark, sf_dir), "quality", "short")), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@catalog.add(
    f"""WITH {JUDGED}, s AS (SELECT doc_id, quality AS t, short AS s, 'quality' AS label FROM j UNION ALL SELECT doc_id, toxic, said, 'toxic' FROM j),
k AS (SELECT label, count(*) FILTER (WHERE t = 1 AND s = 1) AS tp, count(*) FILTER (WHERE t = 0 AND s = 1) AS fp, count(*) FILTER (WHERE t = 1 AND s = 0) AS fn FROM s GROUP BY 1),
m AS (SELECT * FROM k UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM k), q AS (SELECT *, {_PRF} FROM m) SELECT label, tp, fp, fn, {_RATED} FROM q"""
)
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda a, b: F.filter(F.array(F.when(F.col(a) == 1, "quality"), F.when(F.col(b) == 1, "toxic")), lambda x: x.isNotNull())
    rows = judged(spark, sf_dir).select(names("quality", "toxic").alias("true"), names("short", "said").alias("predicted"))
    return rounded(mx.multilabel(rows, "true", "predicted"), "precision", "recall", "f1")


HELD = """h AS (SELECT item_id AS query, doc_id AS target FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, target): documents that hold an item letter for letter."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("part_id"), F.col("text").alias("part"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return corpus.contained(items, docs).select(F.col("part_id").alias("query"), F.col("text_id").alias("target"))


LOOKED = f"WITH {looked.KEYWORD_SQL}, t AS ({looked._top('ks', 5)}), {HELD}"


@catalog.add(
    f"""{LOOKED}, g AS (SELECT query, target, (h.query IS NOT NULL)::INT AS label, t.query IS NOT NULL AS said FROM (SELECT query, target FROM h) h FULL JOIN (SELECT query, target FROM t) t USING (query, target)),
k AS (SELECT count(*) FILTER (WHERE label = 1 AND said) AS tp, count(*) FILTER (WHERE label = 0 AND said) AS fp, count(*) FILTER (WHERE label = 1 AND NOT said) AS fn FROM g), q AS (SELECT *, {_PRF} FROM k) SELECT tp, fp, fn, {_RATED} FROM q"""
)
def link_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = looked.keyword_retrieval(spark, sf_dir).select("query", "target")
    gold = held(spark, sf_dir).withColumn("label", F.lit(1))
    other = found.join(gold, ["query", "target"], "left_anti").withColumn("label", F.lit(0))
    return rounded(mx.link_metrics(found, gold.unionByName(other), ["query", "target"]), "precision", "recall", "f1")


@catalog.add(
    f"""{LOOKED}, s AS (SELECT query, count(*) AS relevant FROM h GROUP BY 1), p AS (SELECT h.query, any_value(relevant) AS relevant, min(rank) AS first, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 5) AS h5 FROM h LEFT JOIN t USING (query, target) JOIN s ON s.query = h.query GROUP BY 1),
m AS (SELECT 1 AS k, h1 AS hit, relevant, first FROM p UNION ALL SELECT 5, h5, relevant, first FROM p)
SELECT k::INT AS k, round(avg(hit / k), 6) AS precision, round(avg(hit / relevant), 6) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / k) * (hit / relevant) / (hit / k + hit / relevant) END), 6) AS f1, round(avg(coalesce(1 / first, 0)), 6) AS mrr, count(*) AS queries FROM m GROUP BY k"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.retrieval_metrics(looked.keyword_retrieval(spark, sf_dir), held(spark, sf_dir), [1, 5]), "precision", "recall", "f1", "mrr")


@catalog.add(
    """WITH r AS (SELECT c_acctbal AS x, c_custkey % 97 AS y FROM customer), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k"""
)
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    return rounded(mx.correlations(rows, "x", "y"), "pearson", "spearman")


@catalog.add(
    f"""WITH {JUDGED}, n AS (SELECT count(*) AS n, avg((quality = short)::INT) AS o FROM j), e AS (SELECT sum(a.c * b.c) AS shared FROM (SELECT quality AS v, count(*) AS c FROM j GROUP BY 1) a JOIN (SELECT short AS v, count(*) AS c FROM j GROUP BY 1) b USING (v))
SELECT n, round(o, 6) AS agreement, round((o - shared / (n * n)) / (1 - shared / (n * n)), 6) AS kappa FROM n, e"""
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.kappa(judged(spark, sf_dir), "quality", "short"), "agreement", "kappa")


@catalog.add("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.percentiles(read(spark, sf_dir, "events"), "value", ["event_type"]), "p50", "p95")


THRESHOLDS = [0.25 * k for k in range(1, 40)]
_SWEEP = f"""{{}} WITH v AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), s AS (SELECT toxic AS label, ln(n_chars) AS score FROM documents JOIN labels USING (doc_id)),
k AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM v, s GROUP BY 1), q AS (SELECT *, {_PRF} FROM k)""".replace("{} ", "")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(F.col("toxic").alias("label"), F.log("n_chars").alias("score"))


@catalog.add(f"{_SWEEP} SELECT threshold, tp, fp, fn, {_RATED} FROM q")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.threshold_sweep(_scored(spark, sf_dir), "label", "score", THRESHOLDS), "precision", "recall", "f1")


@catalog.add(f"{_SWEEP} SELECT threshold, {_RATED.replace('END, 6) AS f1', 'END, 9) AS f1')} FROM q ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = mx.threshold_sweep(_scored(spark, sf_dir), "label", "score", THRESHOLDS)
    return rounded(mx.best_threshold(sweep), "precision", "recall").select("threshold", "precision", "recall", "f1")


SCHEMES = [("equal", 1.0, 1.0, 1.0)] + [(f"without_{n}", *(0.0 if i == k else 1.0 for i in range(3))) for k, n in enumerate(("quantity", "discount", "tax"))] + [(f"{n}_{w}", *(w if i == k else 1.0 for i in range(3))) for k, n in enumerate(("quantity", "discount", "tax")) for w in (0.5, 2.0)]


@catalog.add(
    "WITH w(scheme, a, b, c) AS (VALUES " + ", ".join(map(str, SCHEMES)) + "), m AS (SELECT l_returnflag, avg(l_quantity / 50) AS q, avg(l_discount * 10) AS d, avg(l_tax * 12) AS t FROM lineitem GROUP BY 1) SELECT l_returnflag, scheme, round((q * a + d * b + t * c)::DOUBLE / (a + b + c)::DOUBLE, 6) AS score FROM m, w"
)
def weight_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12).alias("t"))
    grid = spark.createDataFrame(SCHEMES, "scheme string, w_q double, w_d double, w_t double")
    return rounded(mx.weighted_scores(rows, ["l_returnflag"], grid, ["q", "d", "t"]), "score")


@catalog.add("WITH a AS (SELECT o_orderpriority AS k, count(*) AS a FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS overlap, sum(a)::BIGINT AS left_rows, sum(b)::BIGINT AS right_rows FROM a FULL JOIN b USING (k)")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return mx.multiset_overlap(orders.where("o_orderstatus <> 'O'"), orders.where("o_orderstatus <> 'F'"), ["o_orderpriority"])


@catalog.add()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the length rule with its 95 % interval."""
    right = judged(spark, sf_dir).select("doc_id", (F.col("quality") == F.col("short")).cast("int").alias("right"))
    return mx.bootstrap_mean(right, "doc_id", "right")


@catalog.add("SELECT source, count(*) AS test_rows, (sum(count(*)) OVER () - count(*))::BIGINT AS train_rows FROM documents GROUP BY source")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.folds_by_group(read(spark, sf_dir, "documents").select("source"), "source")


@catalog.add(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(substr(text, length(text) // 2 + 1)), '[a-z0-9]+')) AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t"""
)
def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of a text as sets of words."""
    head, tail = fn.tokens(F.expr("left(text, length(text) div 2)")), fn.tokens(F.expr("substring(text, length(text) div 2 + 1)"))
    words = read(spark, sf_dir, "documents").select("doc_id", head.alias("head"), tail.alias("tail"))
    return words.select("doc_id", F.round(mx.set_f1(F.col("head"), F.col("tail")), 6).alias("f1"))




_GOLD = """r AS (SELECT DISTINCT 'S' || l_suppkey AS source_id, 'P' || l_partkey AS target_id FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT 'S' || l_suppkey AS source_id, 'P' || l_partkey AS target_id FROM lineitem WHERE l_quantity > 40),
g AS (SELECT 'S' || s_suppkey AS source_id, 'P' || p_partkey AS target_id FROM supplier, part), j AS (SELECT g.*, r.source_id IS NOT NULL AS t, p.source_id IS NOT NULL AS s FROM g LEFT JOIN r USING (source_id, target_id) LEFT JOIN p USING (source_id, target_id))"""


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers are requirements, parts are code, returned line items are links and large ones predictions."""
    of = lambda t, p, k, layer, text: read(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("id"), F.lit(layer).alias("layer"), F.col(text).alias("content"), F.col(k).alias("place"))
    found = gold.artifacts(of("supplier", "S", "s_suppkey", "use case", "s_name").unionByName(of("part", "P", "p_partkey", "source", "p_name")), {"use case": "requirement", "source": "code"})
    items = read(spark, sf_dir, "lineitem").withColumns({"source_id": F.concat(F.lit("S"), "l_suppkey"), "target_id": F.concat(F.lit("P"), "l_partkey")})
    links = gold.true_links(found, items.select("source_id", "target_id", (F.col("l_returnflag") == "R").cast("int").alias("label")))
    return found, links, items.where("l_quantity > 40").select("source_id", "target_id")


@catalog.add(f"WITH {_GOLD} SELECT (SELECT count(*) FROM supplier) AS requirements, (SELECT count(*) FROM part) AS targets, count(*) AS pairs, count(*) FILTER (WHERE t) AS positives, count(*) FILTER (WHERE NOT t) AS negatives, count(DISTINCT CASE WHEN t THEN source_id END) AS linked_requirements FROM j")
def gold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, links, _ = _gold(spark, sf_dir)
    return gold.classes(found, links)


@catalog.add(f"""WITH {_GOLD}, c AS (SELECT count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn, count(*) FILTER (WHERE NOT t AND NOT s) AS tn FROM j)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def gold_link_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, links, predicted = _gold(spark, sf_dir)
    return rounded(gold.link_metrics(predicted, found, links), "precision", "recall", "f1")


@catalog.add(f"WITH {_GOLD} SELECT count(*) FILTER (WHERE t) AS links, count(*) FILTER (WHERE t AND s) AS reachable, round(count(*) FILTER (WHERE t AND s) / count(*) FILTER (WHERE t), 6) AS ceiling FROM j")
def gold_recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, predicted = _gold(spark, sf_dir)
    return rounded(gold.recall_ceiling(predicted, links), "ceiling")

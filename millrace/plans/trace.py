"""Customers are requirements, parts and orders the artifacts, order totals the confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import trace
from millrace.plans import metrics
from millrace.plans import similarity as looked
from millrace.plans.registry import Catalog, read

catalog = Catalog()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links known so far: orders no longer open. Those not finished yet are the new ones, so the ones in between are both."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return o.select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.when(F.col("o_orderstatus") == "F", "decayed").otherwise("verified").alias("status"), F.lit(1).alias("verified_at"), F.lit(2).alias("last_checked_at")
    )


LINKS = "l AS (SELECT o_custkey AS source_id, o_orderkey AS target_id, o_orderkey % 100 / 100 AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'decayed' ELSE 'verified' END AS status, 1 AS verified_at, 2 AS last_checked_at FROM orders WHERE o_orderstatus <> 'O')"


@catalog.add(
    f"""WITH {LINKS}, n AS (SELECT o_custkey AS source_id, o_orderkey AS target_id, o_orderkey % 10 / 10 AS confidence FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT coalesce(l.source_id, n.source_id) AS source_id, coalesce(l.target_id, n.target_id) AS target_id, round(coalesce(n.confidence, l.confidence), 6) AS confidence, CASE WHEN n.source_id IS NOT NULL THEN 'verified' ELSE status END AS status, coalesce(verified_at, 9) AS verified_at, CASE WHEN n.source_id IS NOT NULL THEN 9 ELSE last_checked_at END AS last_checked_at
FROM l FULL JOIN n ON l.source_id = n.source_id AND l.target_id = n.target_id"""
)
def upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, nodes = _new_links(spark, sf_dir)
    known = links(spark, sf_dir).withColumns({"source_id": _node("c", "source_id", "source_id"), "target_id": _node("o", "target_id", "target_id")})
    return trace.upsert(known, trace.by_ends(new, nodes)[0], nodes).withColumn("confidence", F.round("confidence", 6)).withColumns({c: F.substring(c, 2, 20).cast("long") for c in trace.KEY})


def _new_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links of the orders that are not finished, and the nodes: these orders, and the customers who owe nothing."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    new = o.select(_node("c", "o_custkey", "source_id"), _node("o", "o_orderkey", "target_id"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.lit(9).alias("at"))
    return new, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(_node("c", "c_custkey", "id")).unionByName(o.select(_node("o", "o_orderkey", "id")))


def _node(kind: str, key: str, name: str):
    return F.concat(F.lit(kind), F.col(key).cast("string")).alias(name)


@catalog.add("SELECT 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id, 'source_id' AS missing FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def refused_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.by_ends(*_new_links(spark, sf_dir))[1].select("source_id", "target_id", "missing")


DECAYED = "d AS (SELECT o_custkey AS source_id, o_orderkey AS target_id FROM orders WHERE o_totalprice < 100000)"


@catalog.add(f"WITH {LINKS}, {DECAYED} SELECT l.source_id, l.target_id, round(confidence, 6) AS confidence, CASE WHEN d.source_id IS NULL THEN status ELSE 'decayed' END AS status, verified_at, CASE WHEN d.source_id IS NULL THEN last_checked_at ELSE 7 END AS last_checked_at FROM l LEFT JOIN d ON l.source_id = d.source_id AND l.target_id = d.target_id")
def decay_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.mark_decayed(links(spark, sf_dir), _decayed(spark, sf_dir))[0].withColumn("confidence", F.round("confidence", 6))


def _decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_totalprice < 100000").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.lit("changed").alias("reason"), F.lit(7).alias("at"))


@catalog.add(f"WITH {LINKS}, {DECAYED} SELECT source_id, target_id, 'changed' AS reason, 7 AS flagged_at FROM l JOIN d USING (source_id, target_id)")
def decay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.mark_decayed(links(spark, sf_dir), _decayed(spark, sf_dir))[1]


@catalog.add(f"WITH {LINKS}, h AS (SELECT *, sha256(target_id || ':' || CASE WHEN target_id % 20 = 0 THEN 'old' ELSE (SELECT 'now') END) AS text_hash FROM l) SELECT source_id, target_id FROM h WHERE status = 'verified' AND target_id % 4 = 0 AND text_hash <> sha256(target_id || ':now')")
def decay_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda what: F.sha2(F.concat_ws(":", "target_id", what), 256)
    own = links(spark, sf_dir).withColumn("text_hash", stamp(F.when(F.col("target_id") % 20 == 0, "old").otherwise("now")))
    texts = own.select("target_id", stamp(F.lit("now")).alias("text_hash")).select(F.col("target_id").alias("id"), "text_hash")
    return trace.decay_candidates(own, texts, texts.where("id % 4 = 0")).select("source_id", "target_id")


REQUIREMENTS = "r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 8000 END AS evidence FROM customer)"


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 8000).alias("evidence"))


@catalog.add(
    f"""WITH {LINKS}, r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 7919 END AS evidence FROM customer), t AS (SELECT source_id AS id, avg(target_id % 128 / 128) AS trace, count(*) AS n FROM l WHERE status = 'verified' GROUP BY 1)
SELECT id, coalesce(n, 0) AS n_links, n IS NULL AS orphan, coalesce(trace, 0) AS trace, round_even(CASE WHEN evidence IS NULL THEN coalesce(trace, 0) ELSE 0.6::DOUBLE * coalesce(trace, 0) + 0.4::DOUBLE * least(greatest(evidence, 0), 1) END * 100, 2) AS completeness FROM r LEFT JOIN t USING (id)"""
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences are multiples of 1/128, whose sums are the same in any order."""
    evidence = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 7919)
    known = links(spark, sf_dir).withColumn("confidence", F.col("target_id") % 128 / 128)
    rows = trace.completeness(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), evidence.alias("evidence")), known)
    return rows.select("id", "n_links", "orphan", "trace", "completeness")


@catalog.add(f"WITH {LINKS}, {REQUIREMENTS} SELECT id FROM r WHERE id NOT IN (SELECT source_id FROM l WHERE status = 'verified')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.orphans(requirements(spark, sf_dir), links(spark, sf_dir)).select("id")


@catalog.add(
    f"""{metrics.LOOKED}, v AS (SELECT query, target, CASE WHEN rank <= 3 THEN score >= 0.2 END AS accepted FROM t)
SELECT query, target, CASE WHEN v.query IS NULL THEN 'missed' WHEN accepted IS NULL THEN 'pending' WHEN accepted AND h.query IS NOT NULL THEN 'verified_correct' WHEN accepted THEN 'verified_wrong' WHEN h.query IS NOT NULL THEN 'rejected_true' ELSE 'rejected' END AS category FROM v FULL JOIN h USING (query, target)"""
)
def run_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = looked.keyword_retrieval(spark, sf_dir)
    verdicts = found.where("rank <= 3").select("query", "target", (F.col("score") >= 0.2).alias("accepted"))
    return trace.run_categories(found, verdicts, metrics.held(spark, sf_dir))


@catalog.add("SELECT 'n' || n_nationkey AS id, 'Nation' AS label, n_name AS properties FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'Buyer' ELSE 'Customer' END, c_name FROM customer")
def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    node = lambda df, p, k, label, name: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(label).alias("label"), F.col(name).alias("properties"))
    buyers = customer.join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return trace.export_nodes([node(nation, "n", "n_nationkey", "Nation", "n_name"), node(region, "r", "r_regionkey", "Region", "r_name"), node(customer, "c", "c_custkey", "Customer", "c_name"), node(buyers, "c", "c_custkey", "Buyer", "c_name")])


@catalog.add("SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'IN' AS type, 'first' AS properties FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN', 'first' FROM customer")
def export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda df, a, k, b, m, p: df.select(F.concat(F.lit(a), k).alias("source"), F.concat(F.lit(b), m).alias("target"), F.lit("IN").alias("type"), F.lit(p).alias("properties"))
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    return trace.export_edges([edge(nation, "n", "n_nationkey", "r", "n_regionkey", "first"), edge(customer, "c", "c_custkey", "n", "c_nationkey", "first"), edge(nation, "n", "n_nationkey", "r", "n_regionkey", "again")])


@catalog.add("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 12")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.last_entries(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@catalog.add("SELECT conv_id AS run, count(*) AS events, count(*) FILTER (WHERE role = 'assistant') AS verified, count(*) FILTER (WHERE role = 'system') AS rejected, round(avg(length(text)) FILTER (WHERE role <> 'user'), 6) AS mean_seconds FROM conversations GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "verified").when(F.col("role") == "system", "rejected").otherwise("started")
    events = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), kind.alias("type"), F.length("text").alias("seconds"))
    return trace.run_summary(events).withColumn("mean_seconds", F.round("mean_seconds", 6))

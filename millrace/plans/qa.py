"""Customers are requirements, orders their units, line items the evidence; factors come from the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import qa
from millrace.plans.registry import Catalog, read

catalog = Catalog()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = F.when(F.col("o_orderpriority") == "5-LOW", "UNSUPPORTED").when(F.substring("o_orderpriority", 1, 1) == "4", "REVIEW_REQUIRED").otherwise("SUPPORTED")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rvu_id"), F.col("o_custkey").alias("requirement_id"), support.alias("support_status"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    part = lambda m, n: (F.pmod(F.col("l_partkey") * m + F.col("l_suppkey"), F.lit(n)) / (n - 1)).cast("double")
    return lines.select(
        F.col("l_orderkey").alias("rvu_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
        F.when(F.col("l_linenumber") == 7, "PERFORMANCE").when(F.col("l_linenumber") % 2 == 0, "MANUAL_TEST").otherwise("AUTOMATED_TEST").alias("evidence_type"),
        *(part(m, n).alias(f) for f, m, n in FACTORS),
        F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("NOT_EXECUTED").alias("execution_status"),
        (F.col("l_suppkey") % 10 == 3).alias("synthetic"),
        F.when(F.col("l_partkey") % 7 == 0, False).alias("explicitly_observed"),
    )


FACTORS = (("relevance", 3, 11), ("precondition", 5, 7), ("input", 7, 6), ("condition", 11, 5), ("scenario", 13, 4), ("outcome", 17, 3), ("oracle", 19, 8))
_SCORE = " + ".join(f"{f} * {w}::DOUBLE" for f, w in qa.WEIGHTS.items())
_REASONS = "list_filter([CASE WHEN relevance < 0.35 THEN 'LOW_RELEVANCE' WHEN relevance < 0.55 THEN 'MODERATE_RELEVANCE' END, " + ", ".join(f"CASE WHEN {f} < {low} THEN '{n}' END" for f, (low, n) in qa.REASONS.items()) + "], lambda r: r IS NOT NULL)"
QA_SQL = f"""WITH u AS (SELECT o_orderkey AS rvu_id, o_custkey AS requirement_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'UNSUPPORTED' WHEN o_orderpriority[1] = '4' THEN 'REVIEW_REQUIRED' ELSE 'SUPPORTED' END AS support_status FROM orders),
e AS (SELECT l_orderkey AS rvu_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_linenumber <> 7 AS fine, {', '.join(f'((l_partkey * {m} + l_suppkey) % {n}) / {n - 1} AS {f}' for f, m, n in FACTORS)},
  CASE l_returnflag WHEN 'N' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'NOT_EXECUTED' END AS execution_status, l_suppkey % 10 = 3 AS synthetic, l_partkey % 7 = 0 AS denied FROM lineitem),
s AS (SELECT *, CASE WHEN fine THEN round({_SCORE}, 9) ELSE 0 END AS score, CASE WHEN fine THEN {_REASONS} ELSE ['WRONG_EVIDENCE_TYPE'] END AS reasons FROM e),
a AS (SELECT *, CASE WHEN fine AND relevance >= 0.55 AND score >= 0.72 AND condition >= 0.55 AND scenario >= 0.5 AND outcome >= 0.55 AND oracle >= 0.6 THEN 'ADEQUATE' WHEN fine AND relevance >= 0.35 AND score >= 0.45 THEN 'PARTIAL' ELSE 'INADEQUATE' END AS status FROM s),
r AS (SELECT rvu_id, max_by(evidence_id, row(score, relevance, -evidence_id)) AS best_evidence_id, max_by(relevance, row(score, relevance, -evidence_id)) AS best_relevance, max(score) AS best_adequacy,
  bool_or(status = 'ADEQUATE') AS aa, bool_or(status = 'PARTIAL') AS pp, list_sort(list_distinct(flatten(list(reasons)))) AS fr FROM a WHERE relevance >= 0.35 GROUP BY 1),
m AS (SELECT u.rvu_id, requirement_id, support_status, support_status = 'SUPPORTED' AND r.rvu_id IS NOT NULL AS evidence_found,
  CASE WHEN support_status = 'UNSUPPORTED' THEN 'UNSUPPORTED' WHEN support_status = 'REVIEW_REQUIRED' THEN 'NOT_ASSESSED' WHEN r.rvu_id IS NULL THEN 'INADEQUATE' WHEN aa THEN 'ADEQUATE' WHEN pp THEN 'PARTIAL' ELSE 'INADEQUATE' END AS adequacy_status,
  CASE WHEN support_status = 'UNSUPPORTED' THEN ['UNSUPPORTED_NFR_TYPE'] WHEN support_status = 'REVIEW_REQUIRED' THEN ['HUMAN_REVIEW_REQUIRED'] WHEN r.rvu_id IS NULL THEN ['NO_RELEVANT_EVIDENCE'] ELSE fr END AS reasons,
  CASE WHEN support_status = 'SUPPORTED' THEN best_evidence_id END AS best_evidence_id, CASE WHEN support_status = 'SUPPORTED' THEN coalesce(best_relevance, 0) ELSE 0 END AS best_relevance, CASE WHEN support_status = 'SUPPORTED' THEN coalesce(best_adequacy, 0) ELSE 0 END AS best_adequacy
  FROM u LEFT JOIN r USING (rvu_id)),
x AS (SELECT rvu_id, min(evidence_id) AS execution_evidence_id FROM a WHERE status = 'ADEQUATE' AND NOT denied AND NOT synthetic AND execution_status = 'PASS' GROUP BY 1),
v AS (SELECT m.*, execution_evidence_id, execution_evidence_id IS NOT NULL AS execution_satisfied, CASE WHEN adequacy_status IN ('UNSUPPORTED', 'NOT_ASSESSED') THEN 'NOT_ASSESSED' WHEN adequacy_status = 'ADEQUATE' AND execution_evidence_id IS NOT NULL THEN 'VALIDATED' WHEN adequacy_status IN ('ADEQUATE', 'PARTIAL') THEN 'PARTIAL' ELSE 'UNSATISFIED' END AS validation_status FROM m LEFT JOIN x USING (rvu_id)),
q AS (SELECT requirement_id, count(*) AS total, count(*) FILTER (WHERE support_status = 'SUPPORTED') AS supported, count(*) FILTER (WHERE evidence_found) AS evidence_found, count(*) FILTER (WHERE adequacy_status = 'ADEQUATE') AS adequate, count(*) FILTER (WHERE validation_status = 'VALIDATED') AS validated,
  coalesce(avg(best_relevance) FILTER (WHERE support_status = 'SUPPORTED'), 0) AS r, coalesce(avg(best_adequacy) FILTER (WHERE support_status = 'SUPPORTED'), 0) AS a FROM v GROUP BY 1),
t AS (SELECT *, 0.25 * r + 0.25 * a + 0.25 * (adequate / total) + 0.25 * CASE WHEN supported = 0 THEN 0 ELSE validated / supported END AS rves FROM q)
"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.assess(evidence(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir)
    return qa.validate(qa.summarize(units(spark, sf_dir), rows), qa.satisfied(rows))


@catalog.add(f"{QA_SQL} SELECT evidence_id, round(score, 6) AS adequacy_score, status AS adequacy_status, array_to_string(reasons, ';') AS reasons FROM a")
def adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("evidence_id", F.round("adequacy_score", 6).alias("adequacy_score"), "adequacy_status", F.array_join("reasons", ";").alias("reasons"))


@catalog.add(f"{QA_SQL} SELECT rvu_id, requirement_id, evidence_found, adequacy_status, array_to_string(reasons, ';') AS reasons, best_evidence_id, round(best_relevance, 6) AS best_relevance, round(best_adequacy, 6) AS best_adequacy FROM m")
def adequacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.summarize(units(spark, sf_dir), assessed(spark, sf_dir))
    return rows.select("rvu_id", "requirement_id", "evidence_found", "adequacy_status", F.array_join("reasons", ";").alias("reasons"), "best_evidence_id", F.round("best_relevance", 6).alias("best_relevance"), F.round("best_adequacy", 6).alias("best_adequacy"))


@catalog.add(f"{QA_SQL} SELECT rvu_id, validation_status, execution_evidence_id, array_to_string(CASE WHEN validation_status = 'PARTIAL' AND NOT execution_satisfied THEN list_append(reasons, 'EXECUTION_NOT_CONFIRMED') ELSE reasons END, ';') AS reasons FROM v")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("rvu_id", "validation_status", "execution_evidence_id", F.array_join("reasons", ";").alias("reasons"))


@catalog.add(
    f"""{QA_SQL} SELECT requirement_id, total, supported, evidence_found, adequate, validated, round_even(adequate / total * 100, 2) AS rvc_percent, round_even(CASE WHEN supported = 0 THEN 0 ELSE validated / supported END * 100, 2) AS execution_percent, round(rves, 6) AS rves,
  CASE WHEN supported = 0 THEN 'NOT_ASSESSED' WHEN supported = total AND validated = total THEN 'ADEQUATE' WHEN validated > 0 OR adequate > 0 OR evidence_found > 0 THEN 'PARTIAL' ELSE 'INADEQUATE' END AS status FROM t"""
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.roll_up(validated(spark, sf_dir)).withColumn("rves", F.round("rves", 6))


_ADVICE = "CASE " + " ".join(f"WHEN list_contains(reasons, '{r}') THEN '{t}'" for r, t in qa.ADVICE) + " ELSE 'cover the missing conditions' END"


@catalog.add(
    f"""{QA_SQL}, g AS (SELECT *, CASE WHEN validation_status = 'NOT_ASSESSED' THEN 'SPECIALIZED_REVIEW_REQUIRED' WHEN NOT evidence_found THEN 'MISSING_EVIDENCE' WHEN adequacy_status = 'INADEQUATE' THEN 'INADEQUATE_EVIDENCE' WHEN adequacy_status = 'PARTIAL' THEN 'PARTIAL_EVIDENCE' WHEN NOT execution_satisfied THEN 'FAILED_OR_UNEXECUTED' END AS gap_type FROM v)
SELECT requirement_id, rvu_id, gap_type, CASE WHEN gap_type IN ('SPECIALIZED_REVIEW_REQUIRED', 'PARTIAL_EVIDENCE') THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE gap_type WHEN 'SPECIALIZED_REVIEW_REQUIRED' THEN 'review specialised evidence' WHEN 'MISSING_EVIDENCE' THEN 'create evidence' WHEN 'FAILED_OR_UNEXECUTED' THEN 'execute or fix' ELSE {_ADVICE} END AS recommendation,
  row_number() OVER (PARTITION BY requirement_id ORDER BY rvu_id)::INT AS number FROM g WHERE gap_type IS NOT NULL"""
)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.gaps(validated(spark, sf_dir))


@catalog.add(f"{QA_SQL} SELECT count(*) AS units, count(*) FILTER (WHERE adequacy_status = 'ADEQUATE') AS adequate, count(*) FILTER (WHERE validation_status = 'VALIDATED') AS validated, count(*) FILTER (WHERE best_relevance >= 0.7) AS strong, count(*) FILTER (WHERE best_relevance >= 0.4 AND best_relevance < 0.7) AS medium, count(*) FILTER (WHERE best_relevance < 0.4) AS weak, (SELECT count(*) FROM t) AS requirements, (SELECT round(avg(rves), 6) FROM t) AS mean_rves, round(count(*) FILTER (WHERE adequacy_status = 'ADEQUATE') * 100 / count(*), 6) AS rvc_percent FROM v")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validated(spark, sf_dir)
    return qa.portfolio(rows, qa.roll_up(rows))


@catalog.add(
    """WITH c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS evidence_id, o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderpriority END AS b, o_custkey % 2 <> o_orderkey % 2 AS changed, o_orderpriority[1] = '1' AS is_boundary, o_orderpriority[1] = '2' AS names_old FROM orders),
k AS (SELECT *, CASE WHEN evidence_id IS NULL THEN 'NEW_EVIDENCE_REQUIRED' WHEN lower(a) = lower(b) THEN 'REUSABLE' WHEN changed AND is_boundary THEN 'MODIFICATION_REQUIRED' WHEN changed AND names_old THEN 'OUTDATED' ELSE 'MODIFICATION_REQUIRED' END AS classification FROM c)
SELECT classification, CASE classification WHEN 'NEW_EVIDENCE_REQUIRED' THEN 'CREATE' WHEN 'REUSABLE' THEN 'KEEP' WHEN 'OUTDATED' THEN 'REPLACE' ELSE 'UPDATE' END AS action, count(*) AS cases FROM k GROUP BY 1, 2"""
)
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    cases = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("evidence_id"),
        F.col("o_orderstatus").alias("old_purpose"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("new_purpose"),
        F.array(F.col("o_custkey") % 2).alias("old_constraints"),
        F.array(F.col("o_orderkey") % 2).alias("new_constraints"),
        (first == "1").alias("is_boundary"),
        (first == "2").alias("names_old"),
    )
    return qa.revalidation(cases).groupBy("classification", "action").agg(F.count("*").alias("cases"))


@catalog.add(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 END AS ms, CASE l_linenumber % 3 WHEN 0 THEN '<=' WHEN 1 THEN '>' ELSE '~' END AS op, l_partkey * 20.0 AS t FROM lineitem)
SELECT op, count(*) AS rows, count(*) FILTER (WHERE ms IS NULL) AS no_duration, count(*) FILTER (WHERE CASE op WHEN '<=' THEN ms <= t WHEN '>' THEN ms > t ELSE false END) AS met FROM m GROUP BY op"""
)
def threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(F.lit("ms"), F.lit("sec"), F.lit("Minutes "), F.lit("requests")), F.col("l_linenumber") % 4)
    op = F.get(F.array(F.lit("<="), F.lit(">"), F.lit("~")), F.col("l_linenumber") % 3)
    rows = read(spark, sf_dir, "lineitem").select(op.alias("op"), qa.to_milliseconds(F.col("l_quantity"), unit).alias("ms"), (F.col("l_partkey") * 20.0).alias("t"))
    return rows.groupBy("op").agg(F.count("*").alias("rows"), F.count_if(F.col("ms").isNull()).alias("no_duration"), F.count_if(qa.compare(F.col("ms"), F.col("op"), F.col("t"))).alias("met"))

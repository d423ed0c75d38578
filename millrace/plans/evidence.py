"""Orders ask for evidence, line items are measurements and records of manual runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evidence
from millrace.plans.registry import Catalog, read

catalog = Catalog()
_BEHAVIOURS = ("NEGATIVE", "BOUNDARY", "STATE", "POSITIVE")


@catalog.add(
    f"""WITH r AS (SELECT c_custkey AS requirement_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FUNCTIONAL' ELSE 'NON_FUNCTIONAL' END AS type, CASE WHEN c_acctbal > 0 THEN 'PERFORMANCE' ELSE 'SECURITY' END AS subtype FROM customer),
u AS (SELECT o_orderkey AS rvu_id, o_custkey AS requirement_id, {list(_BEHAVIOURS)}[o_orderkey % 4 + 1] AS kind FROM orders), e AS (SELECT rvu_id, kind, CASE WHEN type = 'FUNCTIONAL' THEN 'FUNCTIONAL_TEST' WHEN subtype = 'PERFORMANCE' THEN 'PERFORMANCE_EVIDENCE' ELSE 'UNSUPPORTED' END AS evidence_type FROM u JOIN r USING (requirement_id))
SELECT rvu_id, evidence_type, CASE WHEN evidence_type = 'UNSUPPORTED' THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS support_status,
  CASE WHEN evidence_type = 'FUNCTIONAL_TEST' THEN CASE kind WHEN 'NEGATIVE' THEN 'Negative validation scenario' WHEN 'BOUNDARY' THEN 'Boundary-value validation scenario' WHEN 'STATE' THEN 'State-transition validation scenario' ELSE 'Positive functional validation scenario' END ELSE '' END AS scenarios,
  CASE WHEN evidence_type <> 'FUNCTIONAL_TEST' THEN 0 WHEN kind = 'POSITIVE' THEN 1 ELSE 2 END AS assertions FROM e"""
)
def evidence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    type_, subtype = F.when(F.col("c_mktsegment") == "BUILDING", "functional").otherwise("non_functional"), F.when(F.col("c_acctbal") > 0, "Performance").otherwise("Security")
    requirements = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requirement_id"), type_.alias("type"), subtype.alias("subtype"))
    kind = F.element_at(F.array(*map(F.lit, _BEHAVIOURS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    units = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rvu_id"), F.col("o_custkey").alias("requirement_id"), kind.alias("behavior_type"), F.col("o_orderpriority").alias("atomic_text"))
    return evidence.profiles(units, requirements).select("rvu_id", "evidence_type", "support_status", F.array_join("required_scenarios", ";").alias("scenarios"), F.size("required_assertions").alias("assertions"))


@catalog.add(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'MANUAL_TEST' ELSE 'PERFORMANCE_EVIDENCE' END AS kind, (l_partkey * 3 + l_suppkey) % 11 / 10 AS relevance,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END::DOUBLE AS metric, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END::DOUBLE AS percentile, CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END::DOUBLE AS load, 1.0::DOUBLE AS duration,
  CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity * 1000 <= 30000 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN l_quantity * 1000 >= 30000 THEN 1 ELSE 0 END ELSE 0.5 END::DOUBLE AS threshold, CASE WHEN l_discount > 0.05 THEN 1 ELSE least(1.0, 0.5 / 0.45) * 0 END::DOUBLE AS scope FROM lineitem),
s AS (SELECT *, CASE WHEN kind = 'MANUAL_TEST' THEN 0 ELSE round(relevance * 0.15::DOUBLE + metric * 0.2::DOUBLE + percentile * 0.1::DOUBLE + load * 0.15::DOUBLE + duration * 0.15::DOUBLE + threshold * 0.15::DOUBLE + scope * 0.1::DOUBLE, 9) END AS score FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(score, 6) AS adequacy_score, CASE WHEN kind = 'MANUAL_TEST' THEN 'INADEQUATE' WHEN relevance >= 0.55 AND score >= 0.8 AND metric = 1 AND percentile = 1 AND load = 1 AND threshold = 1 THEN 'ADEQUATE' WHEN relevance >= 0.35 AND score >= 0.5 THEN 'PARTIAL' ELSE 'INADEQUATE' END AS adequacy_status,
  CASE WHEN kind = 'MANUAL_TEST' THEN 'WRONG_EVIDENCE_TYPE' ELSE array_to_string(list_filter([CASE WHEN relevance < 0.35 THEN 'LOW_RELEVANCE' WHEN relevance < 0.55 THEN 'MODERATE_RELEVANCE' END, CASE WHEN metric = 0 THEN 'NFR_METRIC_MISMATCH' END, CASE WHEN percentile = 0 THEN 'NFR_PERCENTILE_MISMATCH' END,
  CASE WHEN load = 0 THEN 'NFR_LOAD_MISMATCH' END, CASE WHEN threshold = 0 THEN 'NFR_THRESHOLD_MISMATCH' END, CASE WHEN scope < 0.4 THEN 'NFR_SCOPE_MISMATCH' END], lambda x: x IS NOT NULL), ';') END AS reasons FROM s"""
)
def performance_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in seconds are thresholds against half a minute; the flags are metric, percentile and scope."""
    operator = F.get(F.array(F.lit("<="), F.lit(">"), F.lit("~")), F.col("l_linenumber") % 3)
    wanted = F.struct(F.lit("n").alias("metric"), F.lit("o").alias("percentile"), F.lit(10).alias("load"), F.lit(None).cast("int").alias("duration_seconds"), F.lit(30000.0).alias("threshold"), F.lit("ms").alias("unit"), operator.alias("operator"), F.array(F.lit("whole"), F.lit("site")).alias("scope"))
    scope = F.when(F.col("l_discount") > 0.05, F.array(F.lit("whole"))).otherwise(F.array(F.lit("none")))
    given = F.struct(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("percentile"), F.col("l_quantity").alias("load"), F.lit(None).cast("int").alias("duration_seconds"), F.col("l_quantity").cast("double").alias("threshold"), F.lit("sec").alias("unit"), scope.alias("scope"))
    kind = F.when(F.col("l_linenumber") == 7, "MANUAL_TEST").otherwise("PERFORMANCE_EVIDENCE")
    relevance = (F.pmod(F.col("l_partkey") * 3 + F.col("l_suppkey"), F.lit(11)) / 10).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("evidence_type"), relevance.alias("relevance"), wanted.alias("profile"), given.alias("evidence"))
    judged = evidence.assess_performance(evidence.performance_factors(rows))
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("adequacy_score", 6).alias("adequacy_score"), "adequacy_status", F.array_join("reasons", ";").alias("reasons"))


_SUBJECTS = ("The response time", "Latency p 95", "The error rate", "The failed-request rate", "Processing without unhandled failures", "Throughput", "p9 and the P99 response time")
_LIMITS = ("must be below", "shall not exceed", "must be at most", "should be under", "must be at least", "is no more than", "is greater than")
_UNITS = (" ms", " seconds", "s", " percent", "%", " milliseconds", ".5 secs")
_TAILS = (" with 50 concurrent users", " for 10 minutes of sustained workload", " in a test of 2 hours, answers after 3 min", " when the queue is empty, then stop", " after an invalid order", "")
_pick = lambda names, of: f"{list(names)}[({of}) % {len(names)} + 1]"
_ASKED = f"""r AS (SELECT c_custkey AS requirement_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FUNCTIONAL' ELSE 'NON_FUNCTIONAL' END AS type, CASE WHEN c_acctbal > 0 THEN 'PERFORMANCE' ELSE 'SECURITY' END AS subtype, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END AS title, 'Load of ' || c_custkey || ' concurrent users' AS text FROM customer),
u AS (SELECT o_orderkey AS rvu_id, o_custkey AS requirement_id, {_pick(_BEHAVIOURS, "o_orderkey")} AS kind, {_pick(_SUBJECTS, "o_orderkey")} || ' ' || {_pick(_LIMITS, "o_orderkey // 7")} || ' ' || (o_custkey % 1000) || {_pick(_UNITS, "o_orderkey // 49")} || {_pick(_TAILS, "o_custkey")} AS atomic, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 90) || ' sec duration' ELSE '' END AS limits FROM orders),
j AS (SELECT *, text || ' ' || atomic || ' ' || limits AS said, lower(text || ' ' || atomic || ' ' || limits) AS low FROM u JOIN r USING (requirement_id))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are units whose texts are put together from phrases, customers are their requirements."""
    pick = lambda names, of: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    key = F.col("o_orderkey")
    seventh = lambda n: F.floor(key / n)
    number = (F.col("o_custkey") % 1000).cast("string")
    text = F.concat(pick(_SUBJECTS, key), F.lit(" "), pick(_LIMITS, seventh(7)), F.lit(" "), number, pick(_UNITS, seventh(49)), pick(_TAILS, F.col("o_custkey")))
    limits = F.when(key % 5 == 0, F.array(F.concat((key % 90).cast("string"), F.lit(" sec duration")))).otherwise(F.array().cast("array<string>"))
    units = read(spark, sf_dir, "orders").select(key.alias("rvu_id"), F.col("o_custkey").alias("requirement_id"), pick(_BEHAVIOURS, key).alias("behavior_type"), text.alias("atomic_text"), limits.alias("constraints"))
    type_, subtype = F.when(F.col("c_mktsegment") == "BUILDING", "functional").otherwise("non_functional"), F.when(F.col("c_acctbal") > 0, "Performance").otherwise("Security")
    title, load = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" "), F.concat(F.lit("Load of "), F.col("c_custkey").cast("string"), F.lit(" concurrent users"))
    requirements = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requirement_id"), type_.alias("type"), subtype.alias("subtype"), title.alias("title"), load.alias("text"))
    return evidence.expected_evidence(units, requirements)


_LIMIT = "(below|under|less than|at most|no more than|not exceed(ing)?)\\s*([0-9]+(\\.[0-9]+)?)\\s*(milliseconds?|ms|seconds?|secs?|s)"
_RATE = "(below|under|less than|at most|no more than)\\s*([0-9]+(\\.[0-9]+)?)\\s*(percent|%)"
_SAID = f"""{_ASKED}, m AS (SELECT *, CASE WHEN contains(low, 'response time') OR contains(low, 'latency') THEN 'response_time' WHEN contains(low, 'error rate') OR contains(low, 'failed-request rate') THEN 'error_rate' WHEN contains(low, 'unhandled failure') THEN 'unhandled_failures' END AS metric FROM j WHERE type = 'NON_FUNCTIONAL' AND subtype = 'PERFORMANCE'),
places AS (SELECT rvu_id, low, i, substr(low, i, 30) AS here FROM (SELECT rvu_id, low, unnest(generate_series(1, length(low))) AS i FROM m) WHERE regexp_matches(substr(low, i, 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(low, i - 1, 1), '[0-9a-z_]'))),
c AS (SELECT rvu_id, low, i, CASE WHEN regexp_matches(here, '^[0-9]+\\s*(seconds?|secs?|s)\\b') THEN 1 WHEN regexp_matches(here, '^[0-9]+\\s*(minutes?|mins?|min)\\b') THEN 60 WHEN regexp_matches(here, '^[0-9]+\\s*(hours?|hrs?|hr)\\b') THEN 3600 END * regexp_extract(here, '^[0-9]+')::BIGINT AS seconds FROM places),
s AS (SELECT rvu_id, seconds, len(list_filter(['duration', 'for ', 'sustained', 'workload', 'test'], lambda w: contains(substr(low, greatest(i - 60, 1), i - 1 + 60 - greatest(i - 61, 0)), w))) AS score FROM c WHERE seconds IS NOT NULL),
d AS (SELECT rvu_id, seconds AS duration_seconds FROM (SELECT *, row_number() OVER (PARTITION BY rvu_id ORDER BY score DESC, seconds DESC) AS k FROM s) WHERE k = 1),
p AS (SELECT rvu_id, metric, CASE WHEN regexp_matches(low, '\\bp\\s*[0-9]{{2}}\\b') THEN 'p' || regexp_extract(low, '\\bp\\s*([0-9]{{2}})\\b', 1) END AS percentile,
  CASE WHEN regexp_matches(low, 'at most|no more than|not exceed') THEN '<=' WHEN regexp_matches(low, 'below|less than|under') THEN '<' WHEN contains(low, 'at least') THEN '>=' WHEN contains(low, 'greater than') THEN '>' WHEN contains(low, 'without unhandled') THEN '==' END AS operator,
  CASE metric WHEN 'response_time' THEN nullif(regexp_extract(low, '{_LIMIT}', 3), '')::DOUBLE WHEN 'error_rate' THEN nullif(regexp_extract(low, '{_RATE}', 2), '')::DOUBLE WHEN 'unhandled_failures' THEN 0 END AS threshold,
  CASE metric WHEN 'response_time' THEN CASE regexp_extract(low, '{_LIMIT}', 5)[1] WHEN 'm' THEN 'milliseconds' WHEN 's' THEN 'seconds' END WHEN 'error_rate' THEN CASE WHEN regexp_matches(low, '{_RATE}') THEN 'percent' END WHEN 'unhandled_failures' THEN 'count' END AS unit,
  regexp_extract(low, '\\b([0-9]+)\\s+concurrent\\s+users?\\b', 1)::BIGINT AS load, duration_seconds, CASE WHEN trim(title) <> '' THEN title ELSE trim(substr(said, 1, 200)) END AS scope FROM m LEFT JOIN d USING (rvu_id))"""


@catalog.add(f"WITH {_SAID} SELECT rvu_id, metric, percentile, operator, threshold, unit, load, duration_seconds, scope FROM p")
def performance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).where("evidence_type = 'PERFORMANCE_EVIDENCE'")
    return asked.select("rvu_id", "metric", "percentile", "operator", "threshold", "unit", "load", "duration_seconds", "scope")


@catalog.add(
    f"""WITH {_ASKED}, w AS (SELECT *, type = 'FUNCTIONAL' AS f, type <> 'FUNCTIONAL' AND subtype = 'PERFORMANCE' AS p FROM j),
k AS (SELECT *, regexp_matches(low, 'response time|latency|error rate|failed-request rate|unhandled failure') AS known, lower(atomic) AS text_low FROM w)
SELECT rvu_id, CASE WHEN f THEN 'FUNCTIONAL_TEST' WHEN p THEN 'PERFORMANCE_EVIDENCE' ELSE 'SPECIALIZED_NFR_EVIDENCE' END AS evidence_type, CASE WHEN f OR (p AND known) THEN 'SUPPORTED' WHEN p THEN 'REVIEW_REQUIRED' ELSE 'UNSUPPORTED' END AS support_status,
  CASE WHEN f THEN trim(CASE WHEN contains(text_low, 'when ') THEN 'the queue is empty' ELSE '' END || CASE WHEN contains(text_low, 'after ') THEN CASE WHEN contains(text_low, 'after 3') THEN '3 min' ELSE 'an invalid order' END ELSE '' END) ELSE '' END AS preconditions,
  CASE WHEN f THEN array_to_string(list_filter([CASE WHEN contains(text_low, 'invalid') THEN 'Invalid input' END, CASE WHEN contains(text_low, 'valid') THEN 'Valid input' END, CASE WHEN contains(text_low, 'empty') THEN 'Empty input' END], lambda x: x IS NOT NULL), ';') ELSE '' END AS inputs,
  CASE WHEN f THEN CASE WHEN kind = 'POSITIVE' THEN 1 ELSE 2 END WHEN p THEN CASE WHEN regexp_matches(low, '\\bp\\s*[0-9]{{2}}\\b') THEN 2 ELSE 1 END ELSE 1 END AS assertions FROM k"""
)
def expected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(c, ";").alias(c)
    return _asked(spark, sf_dir).select("rvu_id", "evidence_type", "support_status", join("preconditions"), join("inputs"), F.size("required_assertions").alias("assertions"))


@catalog.add(
    f"""WITH {_SAID}, e AS (SELECT l_orderkey AS rvu_id, l_linenumber, l_partkey, ['response_time', 'ERROR_RATE'][l_partkey % 2 + 1] AS metric, CASE WHEN l_linenumber % 2 = 0 THEN 'P95' END AS percentile, l_quantity * 40 AS load, l_suppkey * 30 AS seconds, l_extendedprice AS limit_ms FROM lineitem),
f AS (SELECT rvu_id, l_linenumber, l_partkey, e.load, CASE WHEN p.metric IS NULL OR p.metric = lower(e.metric) THEN 1 ELSE 0 END AS metric_f, CASE WHEN p.percentile IS NULL THEN 1 WHEN e.percentile IS NULL THEN 0 WHEN p.percentile = lower(e.percentile) THEN 1 ELSE 0 END AS percentile_f, CASE WHEN p.load IS NULL OR e.load >= p.load THEN 1 ELSE 0 END AS load_f,
  CASE WHEN p.duration_seconds IS NULL OR e.seconds >= p.duration_seconds THEN 1 ELSE 0 END AS duration_f, p.threshold, p.operator, p.threshold * CASE p.unit WHEN 'seconds' THEN 1000 ELSE 1 END AS asked, limit_ms FROM e JOIN p USING (rvu_id))
SELECT rvu_id, l_linenumber, l_partkey, load::BIGINT AS load, metric_f::DOUBLE AS metric, percentile_f::DOUBLE AS percentile, load_f::DOUBLE AS load_met, duration_f::DOUBLE AS duration,
  (CASE WHEN threshold IS NULL THEN 1 WHEN operator IS NULL THEN 0.5 WHEN operator IN ('<', '<=') THEN CASE WHEN limit_ms <= asked THEN 1 ELSE 0 END WHEN operator IN ('>', '>=') THEN CASE WHEN limit_ms >= asked THEN 1 ELSE 0 END ELSE CASE WHEN limit_ms = asked THEN 1 ELSE 0 END END)::DOUBLE AS threshold FROM f"""
)
def measured_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are measurements for the profiles of their orders."""
    wanted = _asked(spark, sf_dir).where("evidence_type = 'PERFORMANCE_EVIDENCE'").withColumn("scope", F.array("scope"))
    wanted = wanted.select("rvu_id", F.struct("metric", "percentile", "operator", "threshold", "unit", "load", "duration_seconds", "scope").alias("profile"))
    metric = F.element_at(F.array(F.lit("response_time"), F.lit("ERROR_RATE")), (F.col("l_partkey") % 2 + 1).cast("int"))
    given = F.struct(
        metric.alias("metric"), F.when(F.col("l_linenumber") % 2 == 0, "P95").alias("percentile"), (F.col("l_quantity") * 40).alias("load"), (F.col("l_suppkey") * 30).alias("duration_seconds"),
        F.col("l_extendedprice").alias("threshold"), F.lit("ms").alias("unit"), F.array().cast("array<string>").alias("scope"),
    )
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rvu_id"), "l_linenumber", "l_partkey", given.alias("evidence")).join(wanted, "rvu_id")
    out = evidence.performance_factors(rows)
    return out.select("rvu_id", "l_linenumber", "l_partkey", F.col("evidence.load").cast("long").alias("load"), "metric", "percentile", F.col("load").alias("load_met"), "duration", "threshold")


_STATES = ("pass", "FAIL", "BLOCKED", "running")
_RECORDS = f"""r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE (o_orderkey // 2 + 5)::VARCHAR END AS evidence_id, upper({list(_STATES)}[o_custkey % 4 + 1]) AS status, o_orderstatus <> 'P' AS observed, o_orderpriority[1] = '5' AS synthetic, CASE WHEN o_orderpriority[1] = '4' THEN 'a fixture tool' ELSE 'hand' END AS tool FROM orders),
c AS (SELECT *, CASE WHEN evidence_id = '' THEN 'no_evidence_id' WHEN count(*) OVER (PARTITION BY evidence_id) > 1 THEN 'duplicate' WHEN status NOT IN ('PASS', 'FAIL', 'BLOCKED') THEN 'invalid_status' END AS error FROM r)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    rows = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise((F.floor(F.col("o_orderkey") / 2) + 5).cast("string")).alias("evidence_id"), F.element_at(F.array(*map(F.lit, _STATES)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("status"),
        (F.col("o_orderstatus") != "P").alias("observed"), (first == "5").alias("synthetic"), F.when(first == "4", "a fixture tool").otherwise("hand").alias("source_tool"),
    )
    return evidence.check_records(rows)


@catalog.add(f"WITH {_RECORDS} SELECT error, count(*) AS records FROM c WHERE error IS NOT NULL GROUP BY 1")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("error is not null").groupBy("error").agg(F.count("*").alias("records"))


@catalog.add(
    f"""WITH {_RECORDS}, e AS (SELECT o_orderkey::VARCHAR AS evidence_id, o_orderstatus <> 'O' AS manual FROM orders),
k AS (SELECT e.evidence_id, manual, c.status, CASE WHEN NOT manual THEN NULL WHEN c.status IS NULL THEN 'NOT_EXECUTED' WHEN c.status = 'BLOCKED' THEN 'BLOCKED' WHEN synthetic OR NOT observed OR tool = 'a fixture tool' THEN 'CONTROLLED' ELSE 'OBSERVED' END AS execution_kind FROM e LEFT JOIN c ON c.evidence_id = e.evidence_id AND error IS NULL)
SELECT evidence_id, execution_kind, CASE WHEN NOT manual THEN 'PASS' WHEN execution_kind = 'OBSERVED' THEN status ELSE 'NOT_EXECUTED' END AS execution_status, execution_kind = 'OBSERVED' AS execution_observed FROM k"""
)
def manual_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderstatus") != "O", "MANUAL_TEST").otherwise("AUTOMATED_TEST").alias("evidence_type"), F.lit("PASS").alias("execution_status"))
    return evidence.overlay(own, _records(spark, sf_dir)).drop("evidence_type").withColumn("evidence_id", F.col("evidence_id").cast("string"))

"""What evidence is expected, what evidence of performance can prove, and what records say of manual tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import performance
from millrace.functions.columns import clamp
from millrace.operators.qa import RELEVANT, STRONG, to_milliseconds
from millrace.operators.rules import alignment

# Weights of the factors of evidence of performance, and the reason that a factor of zero gives.
WEIGHTS = {"relevance": 0.15, "metric": 0.20, "percentile": 0.10, "load": 0.15, "duration": 0.15, "threshold": 0.15, "scope": 0.10}
REASONS = {"metric": "NFR_METRIC_MISMATCH", "percentile": "NFR_PERCENTILE_MISMATCH", "load": "NFR_LOAD_MISMATCH", "duration": "NFR_DURATION_MISMATCH", "threshold": "NFR_THRESHOLD_MISMATCH"}
ADEQUATE, PARTIAL, SCOPE = 0.80, 0.50, 0.40
# The scenario and the further assertion that a kind of behaviour asks for.
SCENARIOS = {"NEGATIVE": "Negative validation scenario", "BOUNDARY": "Boundary-value validation scenario", "STATE": "State-transition validation scenario", "STATE_TRANSITION": "State-transition validation scenario"}
OUTCOME = "Assert the observable outcome defined by the RVU."
ASSERTIONS = {"NEGATIVE": "Assert that the invalid or disallowed behavior is rejected.", "BOUNDARY": "Assert behavior at the exact boundary and immediately around it.", "STATE": "Assert the expected state after the operation.", "STATE_TRANSITION": "Assert the expected state after the operation."}
# Words of a text that name an input, the clauses that state a precondition, and where such a clause ends.
INPUTS = {"invalid": "Invalid input", "valid": "Valid input", "empty": "Empty input", "missing": "Missing input"}
CLAUSES, CLAUSE_END = ("when", "after"), "(?:,|then|$)"
# What performance asks for, and what proves other qualities.
MEASURED, SCENARIO = "Compare the measured metric against the requirement threshold.", "Execute the required performance scenario under the stated workload."
UNMEASURED = "The performance RVU does not contain a metric currently supported by the deterministic performance adequacy rules."
SPECIALIZED = "Provide measurable evidence for the NFR condition."
GUIDANCE = {
    "SECURITY": "Security test evidence, SAST/DAST or security scan evidence.",
    "SECURITY_BEHAVIOR": "Security-focused validation evidence.",
    "RELIABILITY": "Sustained workload, failure and recovery evidence.",
    "AVAILABILITY": "Availability telemetry and measurement-period evidence.",
    "SCALABILITY": "Load, throughput, latency and resource-utilization evidence.",
    "ACCESSIBILITY": "WCAG or automated accessibility audit evidence.",
    "MAINTAINABILITY": "Coverage, complexity or static analysis evidence.",
    "USABILITY": "Expert review or usability-study evidence.",
    "AUDIT": "Audit-log and trace evidence.",
    "AUTHORIZATION": "Authorization and access-control validation evidence.",
    "DATA_INTEGRITY": "Integrity, persistence and consistency validation evidence.",
}
NO_GUIDANCE = "Specialized non-functional evidence is required."
# States of a record, and names of tools whose runs are staged.
STATES = ("PASS", "FAIL", "NOT_EXECUTED", "BLOCKED")
STAGED = ("CONTROLLED", "SYNTHETIC", "FIXTURE")


def _look_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def profiles(units: DataFrame, requirements: DataFrame) -> DataFrame:
    """``units`` (rvu_id, requirement_id, behavior_type, atomic_text) with the evidence that each asks for.

    ``requirements`` are (requirement_id, type, subtype). Functional units ask for a test of their kind of behaviour,
    performance for a measurement; other kinds are not supported. A unit without its requirement is an error.
    """
    kind = F.upper("behavior_type")
    rows = units.join(requirements, "requirement_id", "left")
    type_ = F.when(F.col("type").isNull(), F.raise_error(F.concat(F.lit("Requirement not found for unit "), F.col("rvu_id").cast("string"))).cast("string")).otherwise(F.upper("type"))
    evidence = F.when(type_ == "FUNCTIONAL", "FUNCTIONAL_TEST").when((type_ == "NON_FUNCTIONAL") & (F.upper("subtype") == "PERFORMANCE"), "PERFORMANCE_EVIDENCE")
    functional = F.col("evidence_type") == "FUNCTIONAL_TEST"
    none = F.array().cast("array<string>")
    scenario = F.array(F.coalesce(_look_up(SCENARIOS, kind), F.lit("Positive functional validation scenario")))
    asserted = F.array_compact(F.array(F.lit(OUTCOME), _look_up(ASSERTIONS, kind)))
    return rows.withColumn("evidence_type", evidence).select(
        "rvu_id", "requirement_id", F.coalesce("evidence_type", F.lit("UNSUPPORTED")).alias("evidence_type"), F.when(F.col("evidence_type").isNull(), "UNSUPPORTED").otherwise("SUPPORTED").alias("support_status"),
        F.when(functional, scenario).otherwise(none).alias("required_scenarios"), F.when(functional, F.array("atomic_text")).otherwise(none).alias("expected_outcomes"), F.when(functional, asserted).otherwise(none).alias("required_assertions"),
    )


def preconditions(text: Column) -> Column:
    """What stands behind the first ``when`` and the first ``after``, up to a comma, ``then`` or the end."""

    def clause(word: str) -> Column:
        found = F.regexp_extract(text, rf"(?iUd)\b{word}\s+(.+?){CLAUSE_END}", 1)
        said = F.contains(F.lower(text), F.lit(f"{word} ")) & (found != "")
        return F.when(said, F.regexp_replace(found, r"(?U)^\s+|\s+$", ""))

    return F.array_compact(F.array(*map(clause, CLAUSES)))


def inputs(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(word)), name) for word, name in INPUTS.items())))


def expected_evidence(units: DataFrame, requirements: DataFrame) -> DataFrame:
    """``units`` (rvu_id, requirement_id, behavior_type, atomic_text, constraints as an array of texts) with all that each
    asks of its evidence.

    ``requirements`` are (requirement_id, type, subtype, title, text). Functional units ask for a test of their kind of
    behaviour with the preconditions and inputs that their text names. Performance asks for a measurement; metric, limits,
    load and duration come from the texts of requirement, unit and constraints, and a unit without a known metric is left
    for review. Other qualities are not judged, only guided. Null texts say nothing; a unit without its requirement is an error.
    """
    rows = units.join(requirements.withColumnRenamed("text", "_text"), "requirement_id", "left")
    lost = F.raise_error(F.concat(F.lit("Requirement not found for unit "), F.col("rvu_id").cast("string"))).cast("string")
    said = F.concat_ws(" ", "_text", "atomic_text", F.array_join("constraints", " "))
    rows = rows.withColumn("type", F.when(F.col("type").isNull(), lost).otherwise(F.upper("type"))).withColumns({"subtype": F.upper("subtype"), "_said": said, "_kind": F.upper("behavior_type")})
    functional, measured = F.col("type") == "FUNCTIONAL", (F.col("type") == "NON_FUNCTIONAL") & F.col("subtype").eqNullSafe(F.lit("PERFORMANCE"))
    rows = rows.withColumn("_p", F.when(measured, performance.profile(F.col("_said"))))
    none = F.array().cast("array<string>")
    load, seconds, percentile = F.col("_p.load"), F.col("_p.duration_seconds"), F.col("_p.percentile")
    loaded = F.array(F.lit(SCENARIO), F.concat(F.lit("Apply at least "), load.cast("string"), F.lit(" concurrent users.")), F.concat(F.lit("Maintain the workload for at least "), seconds.cast("string"), F.lit(" seconds.")))
    compared = F.array(F.lit(MEASURED), F.concat(F.lit("Evaluate the "), percentile, F.lit(" percentile.")))
    scenario = F.array(F.coalesce(_look_up(SCENARIOS, F.col("_kind")), F.lit("Positive functional validation scenario")))
    by = lambda test, measurement, other: F.when(functional, test).when(measured, measurement).otherwise(other)
    known = F.col("_p.metric").isNotNull()
    unsupported = F.concat(F.lit("Automatic adequacy assessment for "), "subtype", F.lit(" evidence is not implemented."))
    title = F.nullif(F.regexp_replace("title", r"(?U)^\s+|\s+$", ""), F.lit(""))
    scope = F.coalesce(title, F.nullif(F.substring(F.regexp_replace(F.regexp_replace("_said", r"(?U)\s+", " "), "^ | $", ""), 1, 200), F.lit("")))
    return rows.select(
        "rvu_id", "requirement_id",
        by(F.lit("FUNCTIONAL_TEST"), F.lit("PERFORMANCE_EVIDENCE"), F.lit("SPECIALIZED_NFR_EVIDENCE")).alias("evidence_type"),
        by(F.lit("SUPPORTED"), F.when(known, "SUPPORTED").otherwise("REVIEW_REQUIRED"), F.lit("UNSUPPORTED")).alias("support_status"),
        by(F.lit(None).cast("string"), F.when(~known, UNMEASURED), unsupported).alias("support_reason"),
        F.array_compact(by(scenario, loaded, F.array(F.coalesce(_look_up(GUIDANCE, F.col("subtype")), F.lit(NO_GUIDANCE))))).alias("required_scenarios"),
        by(preconditions(F.col("atomic_text")), none, none).alias("preconditions"),
        by(inputs(F.col("atomic_text")), none, none).alias("inputs"),
        F.array("atomic_text").alias("expected_outcomes"),
        F.array_compact(by(F.array(F.lit(OUTCOME), _look_up(ASSERTIONS, F.col("_kind"))), compared, F.array(F.lit(SPECIALIZED)))).alias("required_assertions"),
        *(F.col(f"_p.{name}").alias(name) for name in ("metric", "percentile", "operator", "threshold", "unit", "load", "duration_seconds")),
        F.when(measured, scope).alias("scope"),
    )


def _equal(wanted: Column, given: Column) -> Column:
    return F.when(wanted.isNull(), 1.0).when(given.isNull(), 0.0).otherwise((F.lower(wanted) == F.lower(given)).cast("double"))


def _at_least(wanted: Column, given: Column) -> Column:
    return F.when(wanted.isNull(), 1.0).when(given.isNull(), 0.0).otherwise((given >= wanted).cast("double"))


def _threshold(wanted: Column, unit: Column, operator: Column, given: Column, own_unit: Column) -> Column:
    """Whether the evidence tests a threshold at least as strict; durations are compared in milliseconds."""
    required, actual = F.coalesce(to_milliseconds(wanted, unit), wanted), F.coalesce(to_milliseconds(given, own_unit), given)
    met = F.when(operator.isin("<", "<="), actual <= required).when(operator.isin(">", ">="), actual >= required).when(operator.isin("=", "=="), actual == required)
    return F.when(wanted.isNull(), 1.0).when(given.isNull(), 0.0).otherwise(F.coalesce(met.cast("double"), F.lit(0.5)))


def performance_factors(rows: DataFrame) -> DataFrame:
    """Factors of ``rows`` with structs ``profile`` and ``evidence`` (metric, percentile, load, duration_seconds,
    threshold, unit, scope as an array of words; the profile also has an operator). What is not asked for counts as met."""
    of = lambda part, name: F.col(f"{part}.{name}")
    both = lambda name: (of("profile", name), of("evidence", name))
    wanted = F.coalesce(of("profile", "scope"), F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "metric": _equal(*both("metric")),
            "percentile": _equal(*both("percentile")),
            "load": _at_least(*both("load")),
            "duration": _at_least(*both("duration_seconds")),
            "threshold": _threshold(of("profile", "threshold"), of("profile", "unit"), of("profile", "operator"), of("evidence", "threshold"), of("evidence", "unit")),
            "scope": alignment(wanted, F.coalesce(of("evidence", "scope"), F.array().cast("array<string>"))),
        }
    )


def assess_performance(rows: DataFrame, kind: str = "evidence_type") -> DataFrame:
    """Evidence with the factors above and ``relevance``: ``adequacy_score``, ``reasons`` and ``adequacy_status``.

    The measured value itself is no factor: whether it meets the requirement is a question of validation.
    """
    fine = F.col(kind) == "PERFORMANCE_EVIDENCE"
    bounded = rows.withColumn("relevance", clamp(F.col("relevance")))
    score = F.round(sum((F.col(f) * w for f, w in WEIGHTS.items()), F.lit(0.0)), 9)
    first = F.when(F.col("relevance") < RELEVANT, "LOW_RELEVANCE").when(F.col("relevance") < STRONG, "MODERATE_RELEVANCE")
    reasons = F.array_compact(F.array(first, *(F.when(F.col(f) == 0, name) for f, name in REASONS.items()), F.when(F.col("scope") < SCOPE, "NFR_SCOPE_MISMATCH")))
    scored = bounded.withColumn("adequacy_score", F.when(fine, score).otherwise(0.0)).withColumn("reasons", F.when(fine, reasons).otherwise(F.array(F.lit("WRONG_EVIDENCE_TYPE"))))
    strong = fine & (F.col("relevance") >= STRONG) & (F.col("adequacy_score") >= ADEQUATE)
    for f in REASONS:
        strong &= F.col(f) == 1
    partial = fine & (F.col("relevance") >= RELEVANT) & (F.col("adequacy_score") >= PARTIAL)
    return scored.withColumn("adequacy_status", F.when(strong, "ADEQUATE").when(partial, "PARTIAL").otherwise("INADEQUATE"))


def check_records(records: DataFrame) -> DataFrame:
    """Records of manual runs (evidence_id, status, ...) with ``error``: no id, an id that comes twice, an unknown state."""
    trimmed = records.withColumn("evidence_id", F.trim(F.coalesce(F.col("evidence_id").cast("string"), F.lit("")))).withColumn("status", F.upper(F.coalesce("status", F.lit("NOT_EXECUTED"))))
    twice = trimmed.groupBy("evidence_id").agg((F.count("*") > 1).alias("_twice"))
    error = F.when(F.col("evidence_id") == "", "no_evidence_id").when(F.col("_twice"), "duplicate").when(~F.col("status").isin(*STATES), "invalid_status")
    return trimmed.join(twice, "evidence_id").withColumn("error", error).drop("_twice")


def overlay(evidence: DataFrame, checked: DataFrame) -> DataFrame:
    """``evidence`` (evidence_id, evidence_type, execution_status) with what sound records (status, observed, synthetic,
    source_tool) say of manual tests: ``execution_status``, ``execution_kind`` and ``execution_observed``.

    Blocked runs, staged ones (synthetic, from a staging tool or not observed) and tests without a record count as not
    executed. Other evidence is left alone; its kind and observation are null.
    """
    sound = checked.where("error is null").select("evidence_id", F.col("status").alias("_status"), F.coalesce("observed", F.lit(False)).alias("_observed"), F.coalesce("synthetic", F.lit(False)).alias("_synthetic"), F.upper(F.coalesce("source_tool", F.lit(""))).alias("_tool"))
    rows = evidence.withColumn("evidence_id", F.col("evidence_id").cast("string")).join(sound, "evidence_id", "left")
    staged = F.col("_synthetic") | ~F.col("_observed") | F.exists(F.array(*map(F.lit, STAGED)), lambda m: F.contains(F.col("_tool"), m))
    kind = F.when(~F.upper("evidence_type").isin("MANUAL_TEST", "MANUAL"), None).when(F.col("_status").isNull(), "NOT_EXECUTED").when(F.col("_status") == "BLOCKED", "BLOCKED").when(staged, "CONTROLLED").otherwise("OBSERVED")
    done = rows.withColumn("execution_kind", kind)
    status = F.when(F.col("execution_kind").isNull(), F.col("execution_status")).when(F.col("execution_kind") == "OBSERVED", F.col("_status")).otherwise("NOT_EXECUTED")
    return done.withColumn("execution_status", status).withColumn("execution_observed", F.col("execution_kind") == "OBSERVED").select(*evidence.columns, "execution_kind", "execution_observed")

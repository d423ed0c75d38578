"""Evidence adequacy, validation, roll-up to requirements, gaps and revalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import clamp, ratio

# Weights of the factors of functional evidence, and below which value a factor is a reason.
WEIGHTS = {"relevance": 0.20, "precondition": 0.10, "input": 0.10, "condition": 0.15, "scenario": 0.15, "outcome": 0.15, "oracle": 0.15}
RELEVANT, STRONG, ADEQUATE, PARTIAL = 0.35, 0.55, 0.72, 0.45
REASONS = {"precondition": (0.40, "PRECONDITION_MISMATCH"), "input": (0.40, "INPUT_MISMATCH"), "condition": (0.55, "CONDITION_MISMATCH"), "scenario": (0.50, "SCENARIO_MISMATCH"), "outcome": (0.55, "OUTCOME_MISMATCH"), "oracle": (0.60, "WEAK_ORACLE")}
# What a reason asks for, the first that occurs wins.
ADVICE = (("WEAK_ORACLE", "assert the expected outcome"), ("SCENARIO_MISMATCH", "add the required scenario"), ("PRECONDITION_MISMATCH", "set up the preconditions"), ("INPUT_MISMATCH", "exercise the required inputs"), ("CONDITION_MISMATCH", "prove the required behaviour"))
# Factors to milliseconds.
MILLISECONDS = {"ms": 1.0, "millisecond": 1.0, "milliseconds": 1.0, "s": 1000.0, "sec": 1000.0, "second": 1000.0, "seconds": 1000.0, "min": 60000.0, "minute": 60000.0, "minutes": 60000.0, "h": 3600000.0, "hr": 3600000.0, "hour": 3600000.0, "hours": 3600000.0}


def assess(rows: DataFrame, kind: str = "evidence_type") -> DataFrame:
    """Functional evidence with ``adequacy_score``, ``reasons`` and ``adequacy_status``; other kinds are inadequate."""
    fine = F.col(kind).isin("AUTOMATED_TEST", "MANUAL_TEST")
    bounded = rows.withColumns({f: clamp(F.col(f)) for f in WEIGHTS})
    score = F.round(sum((F.col(f) * w for f, w in WEIGHTS.items()), F.lit(0.0)), 9)
    first = F.when(F.col("relevance") < RELEVANT, "LOW_RELEVANCE").when(F.col("relevance") < STRONG, "MODERATE_RELEVANCE")
    reasons = F.filter(F.array(first, *(F.when(F.col(f) < low, name) for f, (low, name) in REASONS.items())), lambda r: r.isNotNull())
    scored = bounded.withColumn("adequacy_score", F.when(fine, score).otherwise(0.0)).withColumn("reasons", F.when(fine, reasons).otherwise(F.array(F.lit("WRONG_EVIDENCE_TYPE"))))
    strong = (F.col("relevance") >= STRONG) & (F.col("adequacy_score") >= ADEQUATE)
    for f in ("condition", "scenario", "outcome", "oracle"):
        strong &= F.col(f) >= REASONS[f][0]
    partial = (F.col("relevance") >= RELEVANT) & (F.col("adequacy_score") >= PARTIAL)
    return scored.withColumn("adequacy_status", F.when(fine & strong, "ADEQUATE").when(fine & partial, "PARTIAL").otherwise("INADEQUATE"))


def summarize(units: DataFrame, assessed: DataFrame) -> DataFrame:
    """One row per unit (rvu_id, requirement_id, support_status): status, best evidence and all reasons.

    The best evidence is the one with the highest adequacy, then relevance; its relevance is reported, not the
    highest. Ties go to the smaller evidence id.
    """
    relevant = assessed.where(F.col("relevance") >= RELEVANT)
    order = F.struct(F.col("adequacy_score"), F.col("relevance"), -F.col("evidence_id"))
    each = relevant.groupBy("rvu_id").agg(
        F.max_by(F.struct("evidence_id", "relevance", "adequacy_score"), order).alias("best"),
        F.bool_or(F.col("adequacy_status") == "ADEQUATE").alias("any_adequate"),
        F.bool_or(F.col("adequacy_status") == "PARTIAL").alias("any_partial"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("found_reasons"),
    )
    joined = units.join(each, "rvu_id", "left")
    supported = F.col("support_status") == "SUPPORTED"
    found = supported & F.col("best").isNotNull()
    status = (
        F.when(F.col("support_status") == "UNSUPPORTED", "UNSUPPORTED").when(F.col("support_status") == "REVIEW_REQUIRED", "NOT_ASSESSED").when(~found, "INADEQUATE").when(F.col("any_adequate"), "ADEQUATE").when(F.col("any_partial"), "PARTIAL").otherwise("INADEQUATE")
    )
    reasons = F.when(F.col("support_status") == "UNSUPPORTED", F.array(F.lit("UNSUPPORTED_NFR_TYPE"))).when(F.col("support_status") == "REVIEW_REQUIRED", F.array(F.lit("HUMAN_REVIEW_REQUIRED"))).when(~found, F.array(F.lit("NO_RELEVANT_EVIDENCE"))).otherwise(F.col("found_reasons"))
    return joined.select(
        "rvu_id", "requirement_id", "support_status", found.alias("evidence_found"), status.alias("adequacy_status"), reasons.alias("reasons"),
        F.when(found, F.col("best.evidence_id")).alias("best_evidence_id"), F.when(found, F.col("best.relevance")).otherwise(0.0).alias("best_relevance"), F.when(found, F.col("best.adequacy_score")).otherwise(0.0).alias("best_adequacy"),
    )


def observed(status: Column, synthetic: Column, explicit: Column) -> Column:
    """Whether an execution counts as observed: what is said explicitly wins, synthetic evidence never counts."""
    return F.coalesce(explicit, F.lit(True)) & ~F.coalesce(synthetic, F.lit(False)) & status.isin("PASS", "FAIL")


def satisfied(rows: DataFrame) -> DataFrame:
    """Units with adequate evidence whose observed execution passed: (rvu_id, execution_evidence_id)."""
    passed = rows.where((F.col("adequacy_status") == "ADEQUATE") & observed(F.col("execution_status"), F.col("synthetic"), F.col("explicitly_observed")) & (F.col("execution_status") == "PASS"))
    return passed.groupBy("rvu_id").agg(F.min("evidence_id").alias("execution_evidence_id"))


def validate(summaries: DataFrame, passed: DataFrame) -> DataFrame:
    joined = summaries.join(passed, "rvu_id", "left")
    done = F.col("execution_evidence_id").isNotNull()
    status = F.when(F.col("adequacy_status").isin("UNSUPPORTED", "NOT_ASSESSED"), "NOT_ASSESSED").when((F.col("adequacy_status") == "ADEQUATE") & done, "VALIDATED").when(F.col("adequacy_status").isin("ADEQUATE", "PARTIAL"), "PARTIAL").otherwise("UNSATISFIED")
    more = F.when((status == "PARTIAL") & ~done, F.array_append("reasons", F.lit("EXECUTION_NOT_CONFIRMED"))).otherwise(F.col("reasons"))
    return joined.withColumn("execution_satisfied", done).withColumn("validation_status", status).withColumn("reasons", more)


def roll_up(validated: DataFrame) -> DataFrame:
    """One row per requirement: counts, percentages, the four factors' mean (RVES) and the status ladder."""
    supported = F.col("support_status") == "SUPPORTED"
    counts = validated.groupBy("requirement_id").agg(
        F.count("*").alias("total"),
        F.count_if(supported).alias("supported"),
        F.count_if(supported & F.col("evidence_found")).alias("evidence_found"),
        F.count_if(F.col("adequacy_status") == "ADEQUATE").alias("adequate"),
        F.count_if(F.col("validation_status") == "VALIDATED").alias("validated"),
        F.coalesce(F.avg(F.when(supported, F.col("best_relevance"))), F.lit(0.0)).alias("r"),
        F.coalesce(F.avg(F.when(supported, F.col("best_adequacy"))), F.lit(0.0)).alias("a"),
    )
    c, e = ratio(F.col("adequate"), F.col("total")), ratio(F.col("validated"), F.col("supported"))
    status = F.when(F.col("supported") == 0, "NOT_ASSESSED").when((F.col("supported") == F.col("total")) & (F.col("validated") == F.col("total")), "ADEQUATE").when((F.col("validated") > 0) | (F.col("adequate") > 0) | (F.col("evidence_found") > 0), "PARTIAL").otherwise("INADEQUATE")
    rated = counts.withColumn("rvc_percent", F.bround(c * 100, 2)).withColumn("execution_percent", F.bround(e * 100, 2)).withColumn("rves", 0.25 * F.col("r") + 0.25 * F.col("a") + 0.25 * c + 0.25 * e)
    return rated.withColumn("status", status).drop("r", "a")


def gaps(validated: DataFrame) -> DataFrame:
    """Units that are not validated: type, severity, action and advice of the first step of the ladder that applies.

    Ids number the gaps of a requirement in the order of its units.
    """
    kind = (
        F.when(F.col("validation_status") == "NOT_ASSESSED", "SPECIALIZED_REVIEW_REQUIRED")
        .when(~F.col("evidence_found"), "MISSING_EVIDENCE")
        .when(F.col("adequacy_status") == "INADEQUATE", "INADEQUATE_EVIDENCE")
        .when(F.col("adequacy_status") == "PARTIAL", "PARTIAL_EVIDENCE")
        .when(~F.col("execution_satisfied"), "FAILED_OR_UNEXECUTED")
    )
    advice = F.lit("cover the missing conditions")
    for reason, text in reversed(ADVICE):
        advice = F.when(F.array_contains("reasons", reason), text).otherwise(advice)
    known = F.when(F.col("gap_type") == "SPECIALIZED_REVIEW_REQUIRED", "review specialised evidence").when(F.col("gap_type") == "MISSING_EVIDENCE", "create evidence").when(F.col("gap_type") == "FAILED_OR_UNEXECUTED", "execute or fix").otherwise(advice)
    rows = validated.withColumn("gap_type", kind).where("gap_type is not null")
    severity = F.when(F.col("gap_type").isin("SPECIALIZED_REVIEW_REQUIRED", "PARTIAL_EVIDENCE"), "MEDIUM").otherwise("HIGH")
    number = F.row_number().over(Window.partitionBy("requirement_id").orderBy("rvu_id"))
    return rows.select("requirement_id", "rvu_id", "gap_type", severity.alias("severity"), known.alias("recommendation"), number.alias("number"))


def revalidation(cases: DataFrame) -> DataFrame:
    """Class of each evidence case after a change: new, reusable, to modify or outdated.

    Cases have evidence_id, the old and new purpose and constraints (arrays), and whether the evidence checks a
    boundary or names an old constraint.
    """
    changed = F.array_sort("old_constraints") != F.array_sort("new_constraints")
    kind = (
        F.when(F.col("evidence_id").isNull(), "NEW_EVIDENCE_REQUIRED")
        .when(F.lower(F.trim("old_purpose")) == F.lower(F.trim("new_purpose")), "REUSABLE")
        .when(changed & F.col("is_boundary"), "MODIFICATION_REQUIRED")
        .when(changed & F.col("names_old"), "OUTDATED")
        .otherwise("MODIFICATION_REQUIRED")
    )
    action = F.create_map(*(F.lit(x) for pair in {"NEW_EVIDENCE_REQUIRED": "CREATE", "REUSABLE": "KEEP", "MODIFICATION_REQUIRED": "UPDATE", "OUTDATED": "REPLACE"}.items() for x in pair))
    return cases.withColumn("classification", kind).withColumn("action", action[F.col("classification")])


def to_milliseconds(value: Column, unit: Column) -> Column:
    """Durations in milliseconds; null for units that are no durations."""
    factors = F.create_map(*(F.lit(x) for pair in MILLISECONDS.items() for x in pair))
    return value * F.try_element_at(factors, F.lower(F.trim(unit)))


def compare(measured: Column, operator: Column, threshold: Column) -> Column:
    """Whether a measurement meets ``operator threshold``; unknown operators are not met."""
    return (
        F.when(operator == "<", measured < threshold)
        .when(operator == "<=", measured <= threshold)
        .when(operator == ">", measured > threshold)
        .when(operator == ">=", measured >= threshold)
        .when(operator.isin("=", "=="), measured == threshold)
        .otherwise(F.lit(False))
    )


def portfolio(validated: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row of totals over all units and requirements."""
    units = validated.agg(F.count("*").alias("units"), F.count_if(F.col("adequacy_status") == "ADEQUATE").alias("adequate"), F.count_if(F.col("validation_status") == "VALIDATED").alias("validated"), F.count_if(F.col("best_relevance") >= 0.7).alias("strong"), F.count_if((F.col("best_relevance") >= 0.4) & (F.col("best_relevance") < 0.7)).alias("medium"), F.count_if(F.col("best_relevance") < 0.4).alias("weak"))
    totals = requirements.agg(F.count("*").alias("requirements"), F.round(F.avg("rves"), 6).alias("mean_rves"))
    return units.join(F.broadcast(totals)).withColumn("rvc_percent", F.round(F.col("adequate") * 100 / F.col("units"), 6))

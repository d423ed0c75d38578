"""Performance profiles against a plain walk over the matches, and the whole of what units ask for."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import performance
from millrace.functions.text import matches
from millrace.operators import evidence

TEXTS = [
    None,
    "",
    "The p95 response time must be below 2.5 seconds for 500 concurrent users during a test of 30 minutes.",
    "Latency shall not exceeding 300ms, P 99 counts; timeout after 90 s",
    "The error rate is no more than 1 % over 1 hour with 20 concurrent user",
    "Runs for 2 hours without unhandled failures",
    "Pages must load under 3 secs",
    "10 seconds. " + "x" * 200 + " sustained workload for 5 min of test",
    "5 sec " + "y" * 61 + "test 7 sec",
    "99999999999999999999 seconds and 12 hours",
    "response time more than 4, at least p5 and p123",
    "response time below 5 ms",
    "x10 seconds 20 secondsx 30 Seconds 40 MIN",
]


def plain(text):
    low = text.lower()
    found = []
    for pattern, unit in performance.DURATIONS.items():
        for m in re.finditer(pattern, text, re.I):
            if int(m[1]) < 1 << 63:
                context = low[max(0, m.start() - 60) : m.start() + 60]
                found.append((sum(w in context for w in performance.DURATION_WORDS), int(m[1]) * unit))
    metric = next((n for n, p in performance.METRICS.items() if any(x in low for x in p)), None)
    operator = next((n for n, p in performance.OPERATORS.items() if any(x in low for x in p)), None)
    threshold = unit = None
    if metric == "response_time" and (m := re.search(performance.TIME_LIMIT, low)):
        threshold, unit = float(m[1]), "milliseconds" if m[2][0] == "m" else "seconds"
    if metric == "error_rate" and (m := re.search(performance.RATE_LIMIT, low)):
        threshold, unit = float(m[1]), "percent"
    if metric == "unhandled_failures" and any(x in low for x in performance.NONE_AT_ALL):
        threshold, unit = 0.0, "count"
    p, load = re.search(performance.PERCENTILE, text, re.I), re.search(performance.LOAD, text, re.I)
    return metric, f"p{p[1]}" if p else None, operator, threshold, unit, int(load[1]) if load else None, max(found)[1] if found else None


def test_profile_equals_a_plain_walk(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in df.select("id", performance.profile(F.col("text")).alias("p")).collect():
        assert tuple(r["p"]) == (plain(TEXTS[r["id"]]) if TEXTS[r["id"]] is not None else (None,) * 7), TEXTS[r["id"]]


@pytest.mark.parametrize("pattern", [r"\d+", "ab", "(?i)A", "x"])
def test_places_of_matches(spark, pattern):
    texts = ["", "ab12ab", "12", "aab 3 b44", "é12é3", "xxx"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", matches(F.col("text"), pattern).alias("m"))
    for r in df.collect():
        assert [tuple(m) for m in r["m"]] == [(m.start(), m[0], m[0]) for m in re.finditer(pattern, r["text"])]


def test_expected_evidence(spark):
    units = [
        (1, 1, "negative", "When the cart is empty, the system shall reject invalid orders after  a timeout ", []),
        (2, 2, "POSITIVE", "The p95 response time is below 2 seconds", ["100 concurrent users", "10 minutes"]),
        (3, 2, "POSITIVE", "It is fast", None),
        (4, 3, "POSITIVE", "It is safe", []),
        (5, 4, "POSITIVE", "It is odd", []),
        (6, 1, None, None, []),
    ]
    requirements = [(1, "functional", "x", None, None), (2, "Non_Functional", "performance", " ", " Speed \n matters "), (3, "NON_FUNCTIONAL", "Security", "t", "x"), (4, "NON_FUNCTIONAL", None, "t", "x")]
    out = evidence.expected_evidence(
        spark.createDataFrame(units, "rvu_id int, requirement_id int, behavior_type string, atomic_text string, constraints array<string>"),
        spark.createDataFrame(requirements, "requirement_id int, type string, subtype string, title string, text string"),
    )
    got = {r["rvu_id"]: r for r in out.collect()}
    assert got[1]["preconditions"] == ["the cart is empty", "a timeout"] and got[1]["inputs"] == ["Invalid input", "Valid input", "Empty input"]
    assert got[1]["required_assertions"] == [evidence.OUTCOME, evidence.ASSERTIONS["NEGATIVE"]] and got[1]["scope"] is None and got[1]["metric"] is None
    assert tuple(got[2][c] for c in ("metric", "percentile", "operator", "threshold", "unit", "load", "duration_seconds", "support_status")) == ("response_time", "p95", "<", 2.0, "seconds", 100, 600, "SUPPORTED")
    assert got[2]["required_scenarios"][1:] == ["Apply at least 100 concurrent users.", "Maintain the workload for at least 600 seconds."]
    assert got[2]["scope"] == "Speed matters The p95 response time is below 2 seconds 100 concurrent users 10 minutes"
    assert got[3]["support_status"] == "REVIEW_REQUIRED" and got[3]["support_reason"] == evidence.UNMEASURED and len(got[3]["required_assertions"]) == 1
    assert got[4]["required_scenarios"] == [evidence.GUIDANCE["SECURITY"]] and got[4]["support_status"] == "UNSUPPORTED"
    assert got[5]["required_scenarios"] == [evidence.NO_GUIDANCE] and got[5]["evidence_type"] == "SPECIALIZED_NFR_EVIDENCE"
    assert got[6]["preconditions"] == [] or got[6]["preconditions"] is None
    with pytest.raises(Exception, match="Requirement not found"):
        evidence.expected_evidence(spark.createDataFrame([(9, 9, "a", "b", [])], "rvu_id int, requirement_id int, behavior_type string, atomic_text string, constraints array<string>"), spark.createDataFrame(requirements, "requirement_id int, type string, subtype string, title string, text string")).collect()

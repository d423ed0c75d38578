"""What a statement of performance asks for: metric, percentile, comparison, threshold, load and duration, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import matches

# Phrases that name a metric, and those that name a comparison; the first group with a phrase in the text wins.
METRICS = {
    "response_time": ["response time", "latency"],
    "error_rate": ["error rate", "failure rate", "failed-request rate", "failed request rate"],
    "unhandled_failures": ["unhandled failure", "unhandled failures", "unhandled application failure"],
}
OPERATORS = {
    "<=": ["less than or equal", "at most", "no more than", "not exceed"],
    "<": ["below", "less than", "under"],
    ">=": ["greater than or equal", "at least", "no less than"],
    ">": ["greater than", "more than", "above"],
    "==": ["without an unhandled", "without unhandled"],
}
# Patterns of a threshold of time and of a rate (in lower case), and phrases that mean none at all.
TIME_LIMIT = r"(?:below|under|less than|at most|no more than|not exceed(?:ing)?)\s*(\d+(?:\.\d+)?)\s*(milliseconds?|ms|seconds?|secs?|s)"
RATE_LIMIT = r"(?:below|under|less than|at most|no more than)\s*(\d+(?:\.\d+)?)\s*(percent|%)"
NONE_AT_ALL = ["without unhandled", "no unhandled"]
PERCENTILE, LOAD = r"\bp\s*(\d{2})\b", r"\b(\d+)\s+concurrent\s+users?\b"
# Patterns of a duration with the seconds in its unit, what stands near the duration of a test, and how near.
DURATIONS = {r"\b(\d+)\s*(seconds?|secs?|s)\b": 1, r"\b(\d+)\s*(minutes?|mins?|min)\b": 60, r"\b(\d+)\s*(hours?|hrs?|hr)\b": 3600}
DURATION_WORDS = ["duration", "for ", "sustained", "workload", "test"]
NEAR = 60
# Any case, Unicode classes.
FLAGS = "(?iU)"


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit |= F.contains(text, F.lit(p))
    return hit


def first_group(text: Column, groups: dict[str, list[str]]) -> Column:
    """Name of the first group of which a phrase occurs in ``text`` (in lower case); null if none does."""
    return F.coalesce(*(F.when(any_of(text, phrases), name) for name, phrases in groups.items()))


def near(text: Column, at: Column, words: Sequence[str], reach: int = NEAR) -> Column:
    """How many of ``words`` are in ``text`` within ``reach`` characters of the place ``at`` on either side."""
    start = F.greatest(F.lit(0), at - reach)
    context = F.substring(text, start + 1, at + reach - start)
    return sum((F.contains(context, F.lit(w)).cast("int") for w in words), F.lit(0))


def duration(text: Column) -> Column:
    """Seconds of the duration with the most DURATION_WORDS around it, of equal ones the longest; null if there is none."""
    low = F.lower(text)

    def of(pattern: str, unit: int) -> Column:
        return F.transform(matches(text, FLAGS + pattern, 1), lambda m: F.struct(near(low, m["at"], DURATION_WORDS).alias("score"), (m["text"].try_cast("bigint") * unit).alias("seconds")))

    found = F.concat(*(of(p, unit) for p, unit in DURATIONS.items()))
    return F.array_max(F.filter(found, lambda d: d["seconds"].isNotNull()))["seconds"]


def profile(text: Column) -> Column:
    """Struct (metric, percentile, operator, threshold, unit, load, duration_seconds) of what ``text`` asks for, null where
    it does not say. Null text asks for nothing; numbers beyond 64 bits count as not said."""
    low = F.lower(text)
    said = lambda pattern, group: F.nullif(F.regexp_extract(low, f"(?U){pattern}", group), F.lit(""))
    metric = first_group(low, METRICS)
    time, rate, none = (metric == name for name in METRICS)
    none = none & any_of(low, NONE_AT_ALL)
    unit = said(TIME_LIMIT, 2)
    threshold = F.when(time, said(TIME_LIMIT, 1).cast("double")).when(rate, said(RATE_LIMIT, 1).cast("double")).when(none, 0.0)
    named = F.when(time & unit.startswith("m"), "milliseconds").when(time & unit.isNotNull(), "seconds").when(rate & said(RATE_LIMIT, 1).isNotNull(), "percent").when(none, "count")
    return F.struct(
        metric.alias("metric"),
        F.concat(F.lit("p"), said(FLAGS + PERCENTILE, 1)).alias("percentile"),
        first_group(low, OPERATORS).alias("operator"),
        threshold.alias("threshold"),
        named.alias("unit"),
        said(FLAGS + LOAD, 1).try_cast("bigint").alias("load"),
        duration(text).alias("duration_seconds"),
    )

"""All queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import architecture, corpus, evidence, evolution, learning, master, metrics, qa, rules, similarity, sourcecode, splits, streaming, text, trace
from millrace.plans.registry import Query

PARTS = (architecture.catalog, evolution.catalog, text.catalog, corpus.catalog, similarity.catalog, metrics.catalog, qa.catalog, trace.catalog, streaming.catalog, learning.catalog, rules.catalog, sourcecode.catalog, splits.catalog, evidence.catalog, master.catalog)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of packages: graph metrics, percentile ranks over the whole table, weighted score and its bin."""
    return architecture.package_risk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, query in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}

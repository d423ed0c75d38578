"""Contracts: records against rules, with the broken ones named and set aside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: names of all rules that do not hold; a rule that is null does not hold."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))
    return rows.withColumn("errors", F.filter(broken, lambda e: e.isNotNull()))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def aliases(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``rows`` with columns under their contract's names where the other spelling came."""
    for old, new in names.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows

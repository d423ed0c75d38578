"""Architecture rules over packages and their dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranks import running_sum



def scope_audit(edges: DataFrame, nodes: DataFrame, group: str | None = None) -> DataFrame:
    """Counts of the dependency rows by what becomes of them: blank, self, out of scope, accepted (distinct edges)."""
    known = nodes.select(F.col("node").alias("_n"))
    rows = edges.join(known, edges["src"] == known["_n"], "left").withColumn("_s", F.col("_n").isNotNull()).drop("_n")
    rows = rows.join(known, rows["dst"] == known["_n"], "left").withColumn("_d", F.col("_n").isNotNull()).drop("_n")
    blank = F.coalesce(F.trim("src") == "", F.lit(True)) | F.coalesce(F.trim("dst") == "", F.lit(True))
    kind = F.when(blank, "blank").when(F.col("src") == F.col("dst"), "self").when(~(F.col("_s") & F.col("_d")), "outside").otherwise("accepted")
    rows = rows.withColumn("_kind", kind)
    return rows.groupBy(*([group] if group else [])).agg(
        F.count_if(F.col("_kind") == "blank").alias("blank_rows"),
        F.count_if(F.col("_kind") == "self").alias("self_rows"),
        F.count_if(F.col("_kind") == "outside").alias("outside_rows"),
        F.count_distinct(F.when(F.col("_kind") == "accepted", F.struct("src", "dst"))).alias("accepted_edges"),
    )


def prefixes(path: Column, separator: str) -> Column:
    """All prefixes of ``path`` that end at a separator or at its end, the longest last."""
    parts = F.split(path, "[" + separator + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def longest_prefix(rows: DataFrame, key: str, path: str, rules: DataFrame, separator: str = ".") -> DataFrame:
    """``rows`` with the columns of the rule (``prefix``, ...) that is the longest prefix of ``path``, nulls if none is.

    The prefixes are exploded and meet the rules in an equi-join: no pair is compared that does not match.
    """
    wide = rows.select(key, F.explode(prefixes(F.col(path), separator)).alias("prefix"))
    best = wide.join(rules, "prefix").groupBy(key).agg(F.max_by(F.struct(*rules.columns), F.length("prefix")).alias("_rule"))
    return rows.join(best, key, "left").select(*rows.columns, "_rule.*")


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct edges between known, different layers that are not allowed (source_layer, target_layer)."""
    a, b = (layers.select(F.col("node").alias(k), F.col("layer").alias(f"{w}_layer")) for k, w in (("src", "source"), ("dst", "target")))
    crossed = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("source_layer <> target_layer")
    return crossed.join(allowed, ["source_layer", "target_layer"], "left_anti").select("src", "dst", "source_layer", "target_layer")


def findings(rows: DataFrame, prefix: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with sequential ids in the given order."""
    return running_sum(rows, order, "_n").withColumn("finding_id", F.format_string(f"{prefix}-%03d", "_n")).drop("_n")


def coupling_findings(metrics: DataFrame, threshold: int = 4) -> DataFrame:
    high = metrics.where(F.col("total_coupling") >= threshold)
    return findings(high, "COUPLING", ["node"]).withColumn("threshold", F.lit(threshold)).withColumn("severity", F.when(F.col("total_coupling") >= 2 * threshold, "High").otherwise("Medium"))


def percentile_rank(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Average-tie rank over the number of values there; nulls stay null. Ranks span the whole table.

    Values are counted first; their counts are summed up by ranges of the values.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    summed = running_sum(values, ["_v"], "_upto", "_n")
    total = values.agg(F.sum("_n").alias("_total"))
    ranked = summed.join(F.broadcast(total)).select("_v", ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_total")).alias(out))
    return rows.join(ranked, rows[column] == ranked["_v"], "left").drop("_v")


def risk(metrics: DataFrame, weights: dict[str, float], cuts: Sequence[tuple[float, str]] = ((0.5, "Low"), (0.8, "Medium"), (1.0, "High"))) -> DataFrame:
    """Weighted percentile ranks in ``risk_score`` and their bin in ``risk_level``."""
    for column in weights:
        metrics = percentile_rank(metrics, column, f"{column}_rank")
    score = sum((F.col(f"{c}_rank") * w for c, w in weights.items()), F.lit(0.0))
    level = F.lit(None).cast("string")
    for cut, name in reversed(list(cuts)):
        level = F.when(F.col("risk_score") <= cut, name).otherwise(level)
    return metrics.withColumn("risk_score", F.round(score, 6)).withColumn("risk_level", level)


__all__ = ["coupling_findings", "findings", "layer_violations", "longest_prefix", "percentile_rank", "prefixes", "risk", "scope_audit"]

"""Gold labels of traceability corpora: artifacts, the links that hold, and all other pairs as a number.

A labelled set has a label for each requirement with each artifact. Only what holds is kept as rows; that all other pairs do
not hold follows from the counts of both sides, and so do the metrics that need them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import ratio
from millrace.functions.text import collapse
from millrace.operators.corpus import first_per_key
from millrace.operators.metrics import f1

REQUIREMENT, CODE = "requirement", "code"


def artifacts(rows: DataFrame, layers: Mapping[str, str]) -> DataFrame:
    """(id, type, text, layer) of ``rows`` (id, layer, content, place): of equal ids the first by place. The text of code is
    kept but for blanks around it, that of others is collapsed. A layer without a type is an error, null content is an empty text."""
    known = F.create_map(*(F.lit(x) for pair in layers.items() for x in pair))
    lost = F.raise_error(F.concat(F.lit("Unknown layer "), F.coalesce("layer", F.lit("null")), F.lit(" for "), F.col("id").cast("string"))).cast("string")
    kind = F.coalesce(F.try_element_at(known, F.coalesce("layer", F.lit(""))), lost)
    content = F.coalesce("content", F.lit(""))
    text = F.when(kind == CODE, F.regexp_replace(content, r"^\s+|\s+$", "")).otherwise(collapse(content))
    return first_per_key(rows.select("id", kind.alias("type"), text.alias("text"), "layer", "place"), ["id"], [F.col("place")]).drop("place")


def artifact_conflicts(rows: DataFrame) -> DataFrame:
    """(id, texts) of the ids that come with more than one content."""
    return rows.groupBy("id").agg(F.count_distinct(F.coalesce("content", F.lit(""))).alias("texts")).where("texts > 1")


def true_links(found: DataFrame, traces: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id, link_type) of the ``traces`` (source_id, target_id, label) with label 1.

    Links without an end among ``found`` (id, type), from something other than a requirement, or to one are errors."""
    a, b = (found.select(F.col("id").alias(f"{s}_id"), F.col("type").alias(f"_{s}")) for s in ("source", "target"))
    both = traces.where("label = 1").select("source_id", "target_id").distinct().join(a, "source_id", "left").join(b, "target_id", "left")
    pair = F.concat(F.col("source_id").cast("string"), F.lit(" -> "), F.col("target_id").cast("string"))
    unknown, odd = F.col("_source").isNull() | F.col("_target").isNull(), (F.col("_source") != REQUIREMENT) | (F.col("_target") == REQUIREMENT)
    kind = F.concat(F.lit("requirement_to_"), "_target")
    error = lambda text: F.raise_error(F.concat(F.lit(text), pair)).cast("string")
    return both.select("source_id", "target_id", F.when(unknown, error("Trace references unknown artifact: ")).when(odd, error("Trace has unexpected layers: ")).otherwise(kind).alias("link_type"))


def classes(found: DataFrame, links: DataFrame) -> DataFrame:
    """One row: requirements, targets, pairs, positives, negatives, linked_requirements. No pair is written out."""
    sides = found.agg(F.count_if(F.col("type") == REQUIREMENT).alias("requirements"), F.count_if(F.col("type") != REQUIREMENT).alias("targets"))
    held = links.agg(F.count("*").alias("positives"), F.count_distinct("source_id").alias("linked_requirements"))
    pairs = F.col("requirements") * F.col("targets")
    return sides.join(F.broadcast(held)).select("requirements", "targets", pairs.alias("pairs"), "positives", (pairs - F.col("positives")).alias("negatives"), "linked_requirements")


def link_metrics(predicted: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of ``predicted`` (source_id, target_id), as over labels of all pairs: repeated
    predictions count once, and those with an end that is no requirement or no target have no label and do not count."""
    key = ["source_id", "target_id"]
    sources, targets = (found.where(c).select(F.col("id").alias(s)) for c, s in ((F.col("type") == REQUIREMENT, "source_id"), (F.col("type") != REQUIREMENT, "target_id")))
    own = predicted.select(*key).distinct().join(sources, "source_id", "left_semi").join(targets, "target_id", "left_semi")
    met = own.withColumn("_p", F.lit(1)).join(links.select(*key).distinct().withColumn("_t", F.lit(1)), key, "full_outer")
    counts = met.agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    rated = counts.join(F.broadcast(classes(found, links).select("pairs"))).withColumn("tn", F.col("pairs") - F.col("tp") - F.col("fp") - F.col("fn"))
    rated = rated.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("tp", "fp", "fn", "tn", "precision", "recall", "f1")


def recall_ceiling(shortlist: DataFrame, links: DataFrame) -> DataFrame:
    """One row (links, reachable, ceiling): the share of the links that a ``shortlist`` (source_id, target_id) has at all, above
    which no verifier behind it can come."""
    key = ["source_id", "target_id"]
    met = links.select(*key).distinct().join(shortlist.select(*key).distinct().withColumn("_s", F.lit(1)), key, "left")
    return met.agg(F.count("*").alias("links"), F.count("_s").alias("reachable")).withColumn("ceiling", ratio(F.col("reachable"), F.col("links")))

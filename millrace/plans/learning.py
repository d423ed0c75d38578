"""Contracts over the tables, and classifiers whose rows only are checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import shared_folder
from millrace.operators import contracts, explain, inference, learn, metrics
from millrace.plans.registry import Catalog, read

catalog = Catalog()


@catalog.add(
    """WITH e AS (SELECT event_id, list_filter([CASE WHEN NOT coalesce(event_type IN ('click', 'view', 'purchase'), false) THEN 'unknown_type' END, CASE WHEN NOT coalesce(value BETWEEN 0 AND 50, false) THEN 'value_out_of_bounds' END,
  CASE WHEN NOT coalesce(regexp_matches(props, '^[{]"k": [0-9]+[}]$'), false) THEN 'bad_props' END], lambda x: x IS NOT NULL) AS errors FROM events)
SELECT event_id, array_to_string(errors, ';') AS errors FROM e WHERE len(errors) > 0"""
)
def contract_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = contracts.aliases(read(spark, sf_dir, "events"), {"eventType": "event_type"})
    rules = {"unknown_type": F.col("event_type").isin("click", "view", "purchase"), "value_out_of_bounds": F.col("value").between(0, 50), "bad_props": F.col("props").rlike('^[{]"k": [0-9]+[}]$')}
    return contracts.quarantine(contracts.check(events, rules)).select("event_id", F.array_join("errors", ";").alias("errors"))


@catalog.add()
def text_classifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by class of a linear text classifier of quality, tuned and tested on rows that it has not seen."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    _, model = learn.tune(rows.where(part < 6), rows.where(part.between(6, 7)), [0.1, 1.0])
    said = model.transform(rows.where(part > 7)).select("label", "prediction")
    return metrics.class_metrics(said, "label", "prediction")


@catalog.add()
def group_fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of quality from sizes, folds by source."""
    rows = sized(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id"), F.col("quality").cast("double").alias("label"))
    return learn.out_of_fold(rows, list(SIZES), "source").select("doc_id", "source", "fold", "prediction")


SIZES = ("chars", "lines", "marks")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"), F.length(F.regexp_replace(text, r"[\p{L}\s]", "")).cast("double").alias("marks"), *more
    )


@catalog.add()
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a stored model of the labelled ones, with the size that moves each score most."""
    docs = read(spark, sf_dir, "documents")
    known = sized(docs.join(read(spark, sf_dir, "labels"), "doc_id"), F.col("quality").alias("label"))
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    model = inference.fit(known, SIZES, "label")
    inference.store(spark, folder, model, SIZES, "label")
    rows = sized(docs)
    moved = explain.top_features(explain.shapley(rows, explain.tree_table(spark, model.stages[-1]), "doc_id", SIZES), 1)
    said = inference.score(rows, folder, ["doc_id"]).select("doc_id", "proxy_probability", "predicted_proxy_label")
    return said.join(moved.select(F.col("sample").alias("doc_id"), "feature", "direction"), "doc_id")

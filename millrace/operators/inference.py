"""Fitted classifiers stored with the features that they were fitted on, and scores of new rows by them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import require

# What a score means, and the folders whose sources are not counted.
MEANING = "Exploratory architecture-change proxy prediction; not validated architecture-drift detection."
SKIPPED = (".git", ".venv", "target", "build", "out", "node_modules")


def fit(rows: DataFrame, columns: Sequence[str], target: str, trees: int = 10, depth: int = 3) -> PipelineModel:
    """Boosted trees for the 0/1 column ``target``; gaps in the numeric ``columns`` get the median of the rows."""
    filled = [f"_{c}" for c in columns]
    stages = [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol=target, maxIter=trees, maxDepth=depth, seed=327),
    ]
    known = rows.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in (*columns, target)})
    return Pipeline(stages=stages).fit(known)


def store(spark: SparkSession, folder: str, model: PipelineModel, columns: Sequence[str], target: str) -> None:
    """Writes model and schema; a folder that is there already is an error, as a model is never changed in place."""
    model.write().save(f"{folder}/model")
    schema = json.dumps({"features": list(columns), "target": target})
    spark.createDataFrame([(schema,)], "value string").coalesce(1).write.text(f"{folder}/schema")


def score(rows: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """``keys`` of every row with proxy_probability (of class 1, to four digits), predicted_proxy_label, target and interpretation.

    Rows must have all features that the model was fitted on, under their names; their order does not matter, other
    columns are ignored, nulls are filled as in training. A folder without a model is an error.
    """
    spark = rows.sparkSession
    schema = json.loads(spark.read.text(f"{folder}/schema").first()[0])
    features = schema["features"]
    model = PipelineModel.load(f"{folder}/model")
    wide = require(rows, *features, *keys).select(F.struct(*keys).alias("_keys"), *(F.col(c).cast("double").alias(c) for c in features))
    said = model.transform(wide)
    return said.select(
        "_keys.*",
        F.bround(F.get(vector_to_array("probability"), F.lit(1)), 4).alias("proxy_probability"),
        F.col("prediction").cast("int").alias("predicted_proxy_label"),
        F.lit(schema["target"]).alias("target"),
        F.lit(MEANING).alias("interpretation"),
    )


def nonempty_lines(files: DataFrame) -> DataFrame:
    """(package, nonempty_lines) over the source ``files`` (path, text); a file belongs to the package of its first line
    that begins with ``package`` and ends with a semicolon, without one to the package ''. Null texts have no lines."""
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    named: Column = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("package ")) & F.endswith(x, F.lit(";"))), F.lit(0))
    package = F.coalesce(F.trim(F.expr("substring(_named, 9, length(_named) - 9)")), F.lit(""))
    read = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    counted = read.select(named.alias("_named"), F.size(F.filter(lines, lambda x: x != "")).alias("n")).where("n >= 0")
    return counted.groupBy(package.alias("package")).agg(F.sum("n").alias("nonempty_lines"))

"""Text classifiers on Spark's own learners, with balanced weights, group folds and deterministic choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, PredictionModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Imputer, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import metrics


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``: n / (classes * rows of the class). There is one row a class to broadcast."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_c"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_c") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def text_features(size: int = 1 << 12) -> Pipeline:
    """Words and word pairs, hashed and weighted by idf (at least two documents)."""
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    counted = [HashingTF(numFeatures=size, inputCol=i, outputCol=f"{i}_tf") for i in ("_words", "_pairs")]
    both = VectorAssembler(inputCols=["_words_tf", "_pairs_tf"], outputCol="_tf")
    return Pipeline(stages=[words, pairs, *counted, both, IDF(minDocFreq=2, inputCol="_tf", outputCol="features")])


def linear(kind: str, c: float) -> LogisticRegression | LinearSVC:
    learner = LinearSVC if kind == "svm" else LogisticRegression
    return learner(labelCol="label", weightCol="weight", regParam=1 / c / 1000, maxIter=15)


def tune(train: DataFrame, held: DataFrame, grid: Sequence[float], kind: str = "lr") -> tuple[float, PipelineModel]:
    """The model of the C with the best macro F1 on ``held``; of equals the smaller C. Rows have text and label (0/1)."""
    features = text_features().fit(train)
    keep = ("label", "features")
    learnt, judged = balanced(features.transform(train).select(*keep), "label").cache(), features.transform(held).select(*keep).cache()
    best: tuple[float, float, PipelineModel] | None = None
    for c in sorted(grid):
        model = linear(kind, c).fit(learnt)
        scored = metrics.class_metrics(model.transform(judged).select("label", "prediction"), "label", "prediction")
        value = round(metrics.summary(scored).first().macro_f1 or 0.0, 9)
        if best is None or value > best[0]:
            best = (value, c, PipelineModel(stages=[features, model]))
    learnt.unpersist()
    judged.unpersist()
    return best[1], best[2]


def out_of_fold(rows: DataFrame, columns: Sequence[str], group: str, folds: int = 3) -> DataFrame:
    """Boosted trees on numeric ``columns``: each row's prediction comes from a model that has not seen its group.

    A group's fold is a hash of its name; gaps are filled with medians of the rows that are learnt from.
    """
    dealt = rows.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    filled = [f"_{c}" for c in columns]
    out = None
    for fold in range(folds):
        train, test = balanced(dealt.where(F.col("_fold") != fold), "label"), dealt.where(F.col("_fold") == fold)
        stages = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTClassifier(labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, seed=327)]
        part = Pipeline(stages=stages).fit(train).transform(test).select(*rows.columns, "prediction", F.col("_fold").cast("int").alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out


def one_vs_rest(train: DataFrame, labels: Sequence[str], kind: str = "lr", c: float = 1.0) -> tuple[PipelineModel, dict[str, PredictionModel]]:
    """Shared text features and a binary model for each of the columns ``labels`` (0/1); rows without a label teach others only."""
    features = text_features().fit(train)
    learnt = features.transform(train).select("features", *labels).cache()
    models = {}
    for name in labels:
        own = learnt.where(F.col(name).isNotNull()).select("features", F.col(name).cast("double").alias("label"))
        models[name] = linear(kind, c).fit(balanced(own, "label"))
    learnt.unpersist()
    return features, models


def labels_of(fitted: tuple[PipelineModel, dict[str, PredictionModel]], rows: DataFrame) -> DataFrame:
    """``rows`` with ``<label>_pred`` (0/1) for each label that was learnt."""
    features, models = fitted
    out = features.transform(rows).select(*rows.columns, "features")
    for name, model in models.items():
        said = model.transform(out)
        out = said.select(*out.columns, F.col("prediction").cast("int").alias(f"{name}_pred"))
    return out.drop("features")

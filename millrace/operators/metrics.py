"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import ratio


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.groupBy(true, predicted).agg(F.count("*").alias("count"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def class_metrics(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) from one pass over the confusion counts."""
    cells = confusion(rows.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()), true, predicted)
    same = F.col(true) == F.col(predicted)
    sides = cells.select(F.col(true).alias("class"), F.when(same, F.col("count")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(same, 0).otherwise(F.col("count")).alias("fn")).unionByName(
        cells.where(~same).select(F.col(predicted).alias("class"), F.lit(0).alias("tp"), F.col("count").alias("fp"), F.lit(0).alias("fn"))
    )
    sums = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("support", F.col("tp") + F.col("fn"))
    rated = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def summary(classes: DataFrame) -> DataFrame:
    """Accuracy and macro averages over the classes that occur."""
    present = classes.where("support > 0")
    return present.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def multilabel(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """Micro and macro precision, recall and F1 of label arrays; one row per label and one for ``micro``."""
    every = rows.select(F.explode(F.array_union(true, predicted)).alias("label"), true, predicted)
    hit = lambda c: F.array_contains(c, F.col("label"))
    per = every.groupBy("label").agg(F.count_if(hit(true) & hit(predicted)).alias("tp"), F.count_if(~hit(true) & hit(predicted)).alias("fp"), F.count_if(hit(true) & ~hit(predicted)).alias("fn"))
    total = per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(F.lit("micro").alias("label"), "tp", "fp", "fn")
    both = per.unionByName(total)
    rated = both.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def link_metrics(predicted: DataFrame, gold: DataFrame, key: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of predicted links; pairs without a gold label are ignored. ``gold`` has ``label`` 0/1."""
    both = gold.join(predicted.select(*key).distinct().withColumn("_p", F.lit(True)), list(key), "left")
    yes, said = F.col("label") == 1, F.col("_p").isNotNull()
    counts = both.agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    rated = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Mean precision, recall and F1 at each cut and the mean reciprocal rank, over queries with a relevant target."""
    wanted = relevant.select("query", "target").distinct()
    sizes = wanted.groupBy("query").agg(F.count("*").alias("relevant"))
    hits = wanted.join(ranked.select("query", "target", "rank"), ["query", "target"], "left")
    per = hits.groupBy("query").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cuts)).join(sizes, "query")
    out = None
    for k in cuts:
        p, r = F.col(f"h{k}") / k, F.col(f"h{k}") / F.col("relevant")
        row = per.agg(F.lit(k).alias("k"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1(p, r)).alias("f1"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))
        out = row if out is None else out.unionByName(row)
    return out


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks of ties); ranks come from the counts of distinct values."""
    from millrace.operators.architecture import percentile_rank

    there = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = percentile_rank(percentile_rank(there, x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: 1 where chance agreement is complete, null with fewer than two rows."""
    there = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = there.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    left, right = (there.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(k)) for c, k in ((a, "l"), (b, "r")))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("both"))
    expected = F.col("both") / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") < 2, F.lit(None)).when(expected > 1 - 1e-12, F.lit(1.0)).otherwise((F.col("observed") - expected) / (1 - expected))
    return n.join(F.broadcast(chance)).select("n", F.col("observed").alias("agreement"), value.alias("kappa"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; two empty ones agree."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2 * both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def multiset_overlap(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sum over keys of the smaller of both counts, and both totals."""
    a, b = left.groupBy(*key).agg(F.count("*").alias("_a")), right.groupBy(*key).agg(F.count("*").alias("_b"))
    both = a.join(b, list(key), "full_outer").na.fill(0, ["_a", "_b"])
    return both.agg(F.sum(F.least("_a", "_b")).alias("overlap"), F.sum("_a").alias("left_rows"), F.sum("_b").alias("right_rows"))


def threshold_sweep(scored: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, from one pass: every threshold is a column of conditional counts."""
    counts = scored.agg(F.count_if(F.col(label) == 1).alias("_all"), *(c for i, t in enumerate(thresholds) for c in (F.count_if(F.col(score) >= t).alias(f"_s{i}"), F.count_if((F.col(score) >= t) & (F.col(label) == 1)).alias(f"_t{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("tp"), (F.col(f"_s{i}") - F.col(f"_t{i}")).alias("fp"), (F.col("_all") - F.col(f"_t{i}")).alias("fn")) for i, t in enumerate(thresholds))))
    each = counts.select(rows.alias("r")).select("r.*")
    rated = each.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_threshold(sweep: DataFrame, digits: int = 9) -> DataFrame:
    """The threshold with the best F1, the higher one of equals."""
    return sweep.withColumn("f1", F.round("f1", digits)).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def weighted_scores(rows: DataFrame, key: Sequence[str], weights: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Mean weighted score of each key under each row of ``weights`` (scheme, one column a factor named w_factor).

    The factors are averaged first, so the grid meets one row a key.
    """
    means = rows.groupBy(*key).agg(*(F.avg(f).alias(f) for f in factors))
    total = sum((F.col(f"w_{f}") for f in factors), F.lit(0.0))
    score = sum((F.col(f) * F.col(f"w_{f}") for f in factors), F.lit(0.0)) / total
    return means.join(F.broadcast(weights)).select(*key, "scheme", score.alias("score"))


def bootstrap_mean(rows: DataFrame, id_col: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 327) -> DataFrame:
    """Percentile interval of the mean under resampling by hash: each row counts Poisson(1) times in each resample.

    Counts depend on id, resample and seed alone, so reruns and any partitioning agree. Rows are spread by
    resample and summed where they lie.
    """
    each = rows.where(F.col(value).isNotNull()).select(id_col, F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_b")), F.lit(1 << 30)) / float(1 << 30)
    count, mass, below = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 9):
        below += mass
        mass /= k
        count = F.when(u >= below, F.lit(k)).otherwise(count)
    means = each.withColumn("_c", count).groupBy("_b").agg((F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.count("*").alias("resamples"))


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), cuts: Sequence[int] = (50, 95)) -> DataFrame:
    """``p<cut>`` of ``value``, exact and interpolated between neighbours, of all rows or of each group; latencies are such
    values. Nulls do not count, and a group of nulls alone has null percentiles.

    Equal values are counted first, so a group is held as its distinct values.
    """
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(*(F.percentile("_v", cut / 100, F.col("_n")).alias(f"p{cut}") for cut in cuts))


def folds_by_group(rows: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out: each group's rows held out, and how many rows are left to learn from."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("test_rows"))
    return sizes.withColumn("train_rows", F.sum("test_rows").over(Window.partitionBy()) - F.col("test_rows"))

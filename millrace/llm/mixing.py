"""Mixing sources to target weights, with built-in functions only.

Every document gets a hash-random key. Within each source the keys are range-sorted: the leading bits of the key
name one of ``BUCKETS`` ranges, so that also a source with a third of all rows is spread over as many tasks. The
sums of the ranges are added up over the ranges of a source, the sizes of the documents within each range, and
the two together say how many words of a source come before each document. A source's budget takes whole epochs
first and then cuts the last one at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import content_key, settle, whole

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
WEIGHTS = (1, 2, 3)
CAP = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of the total by weight, at most ``cap`` sizes each.

    Sources take the weights in turn, by code point with null last. What a capped source leaves is shared by
    weight among the others until none is above: sources are capped in the order of size by weight for as long as
    their cap lies below what an even level would give them. There is one row a source here, not a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("place", F.row_number().over(by_level))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rest", F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("capped"))
    )
    open_ = (F.col("source_size") * float(cap)) * F.col("heavy") >= F.col("rest") * F.col("weight")
    first = F.min(F.when(open_, F.struct("place", F.col("rest").cast("double").alias("rest"), F.col("heavy").cast("double").alias("heavy"))))
    level = first.over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    even = F.col("level.rest") * F.col("weight") / F.col("level.heavy")
    return rows.select("source", "source_size", F.least(even, (F.col("source_size") * cap).cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """One row per document: ``id_col``, ``text_key``, ``size``, ``source_size``, ``target``, ``epochs``, ``before``, ``budget``, ``taken``.

    ``size`` counts words (null or empty text: 0); ``taken`` is how many words the mix takes, ``epochs`` how often
    the whole source goes in, ``before`` the words of the source that precede the document in the cut epoch. Null
    sources are one source, last in order. Null ids share a key; ties go by content, and rows that repeat both are
    each counted. The keys depend on ``seed`` and the id alone, so reruns agree. Empty input, empty output.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"),
            content_key(F.col(text_col)).alias("text_key"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("of"),
            words(F.col(text_col)).alias("size"),
            key.alias("key"),
        ).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), 2))
    )
    ranges = rows.groupBy("of", "bucket").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    before = F.sum("range_size").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ranges = settle(ranges.withColumn("range_before", F.coalesce(before, F.lit(0))))
    sizes = ranges.groupBy("of").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    goals = targets(sizes.select("source", "source_size"), weights, cap).withColumn("budget", F.floor(F.col("target") + 0.5))
    goals = goals.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    placed = ranges.select("of", "bucket", "range_before").join(goals, "of")
    within = Window.partitionBy("of", "bucket").orderBy("key", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("within", F.sum("size").over(within) - F.col("size")).join(placed, ["of", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    cut = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (
        summed.withColumn("epochs", epochs)
        .withColumn("before", F.col("range_before") + F.col("within"))
        .withColumn("cut", cut)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("cut") - F.col("before"))))
        .select(F.col("id").alias(id_col), "text_key", "size", "source_size", "target", "epochs", "before", "cut", "taken")
    )


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns as in ``docs``.

    A document comes once for each whole epoch of its source and once more if it starts before the cut; the one
    at the cut comes whole.
    """
    plan = mix(docs, id_col, text_col, source_col, seed=seed)
    copies = plan.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).agg(F.max(F.col("epochs") + (F.col("before") < F.col("cut")).cast("long")).alias("_copies"))
    copies = settle(copies.where("_copies > 0"))
    keyed = docs.select(whole(docs), F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("key"))
    joined = keyed.join(copies, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("doc.*")

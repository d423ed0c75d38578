"""Labelled text corpora: deduplication, conflicts, overlap and leakage between parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (which must name a unique last column), by aggregation."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def also_in(rows: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """Sorted distinct sources of each key, joined by semicolons."""
    return rows.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(source)), ";").alias("also_in"), F.count("*").alias("copies"))


def conflicts(rows: DataFrame, key: str, source: str, label: str, across: bool) -> DataFrame:
    """Keys with more than one label, within one source or (``across``) over two sources or more."""
    by = [key] if across else [key, source]
    found = rows.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count_distinct(label).alias("labels"), F.count_distinct(source).alias("sources"), F.count("*").alias("rows"))
    return found.where((F.col("labels") > 1) & (F.col("sources") >= (2 if across else 1)))


def annotation_conflicts(rows: DataFrame, key: str, source: str, columns: Sequence[str]) -> DataFrame:
    """Wide annotation columns as rows (key, category), with a conflict where two sources disagree."""
    long = rows.unpivot([key, source], list(columns), "category", "value").where("value is not null")
    out = long.groupBy(key, "category").agg(F.count_distinct(source).alias("sources"), F.count_distinct("value").alias("values"))
    return out.withColumn("conflict", (F.col("sources") >= 2) & (F.col("values") > 1))


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``, zeros filled in."""
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def remove_leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Rows that may stay: a text of the train part leaves the others, one of the test part leaves validation."""
    parts = rows.groupBy(key).agg(*(F.bool_or(F.col(split) == s).alias(f"_{s}") for s in ("train", "test")))
    joined = rows.join(parts, key)
    gone = ((F.col(split) != "train") & F.col("_train")) | ((F.col(split) == "validation") & F.col("_test"))
    return joined.where(~gone).drop("_train", "_test")


def hash_order(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def hash_sample(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The n rows whose keyed hash comes first: a sample that any rerun repeats."""
    return rows.withColumn("order_key", hash_order(seed, F.col(key))).orderBy("order_key", key).limit(n)


def quota_sample(rows: DataFrame, seed: str, key: str, stratum: str, quota: int, margin: float = 10.0) -> DataFrame:
    """Up to ``quota`` rows of each stratum in hash order; null is a stratum too.

    A first cut by the leading hash digits, sized by each stratum's count, bounds what the ranking has to sort. A
    stratum of which that leaves less than its quota, however unlikely at this ``margin``, is ranked whole.
    """
    keyed = rows.withColumn("order_key", hash_order(seed, F.col(key)))
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    place = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = place <= (quota + margin * (quota**0.5 + 2)) / F.col("_n")
    met = keyed.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    left = met.groupBy(F.col("_s").alias("_t")).agg((F.count_if(near) < F.least(F.lit(quota), F.first("_n"))).alias("_short"))
    chosen = met.join(left, F.col("_s").eqNullSafe(F.col("_t"))).where(near | F.col("_short"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("order_key", key))
    return chosen.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_n", "_s", "_t", "_short", "_rank")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both corpora, with their counts on either side."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    return a.join(b, key)


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.select(key).distinct().join(right, key, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(key).distinct().join(left, key, "left_anti").withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def contained(parts: DataFrame, texts: DataFrame, width: int = 8) -> DataFrame:
    """(part_id, text_id) for every ``text`` (text_id, text; ids are unique) that contains a ``part`` (part_id, part).

    Texts are cut into pieces of ``width`` characters; a part of twice this less one, wherever it begins, has one of these pieces
    among those at its first ``width`` places. Parts too short for this meet texts over the characters at all places, of
    which only as many are looked at as the shortest part has. What meets is checked whole. Null and empty parts are in no text.
    """
    sized = parts.select("part_id", "part", F.length("part").alias("n")).where("n > 0")
    long, short = sized.where(F.col("n") >= 2 * width - 1), sized.where(F.col("n") < 2 * width - 1)
    starts = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(F.col("part"), i, F.lit(width)))
    pieces = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s).{{{width}}}"), 0))
    met = texts.select("text_id", F.explode(pieces).alias("gram")).join(long.select("part_id", F.explode(F.array_distinct(starts)).alias("gram")), "gram").select("part_id", "text_id")
    if (least := short.agg(F.min("n")).first()[0]) is not None:
        every = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{least}}}))"), 1))
        own = short.select("part_id", F.substring("part", 1, least).alias("gram"))
        met = met.unionByName(texts.select("text_id", F.explode(every).alias("gram")).join(own, "gram").select("part_id", "text_id"))
    whole = met.distinct().join(texts.select("text_id", "text"), "text_id").join(parts.select("part_id", "part"), "part_id")
    return whole.where(F.contains("text", F.col("part"))).select("part_id", "text_id").distinct()


def gates(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(check, failures, passed) for frames of failing rows, each counted where it lies."""
    out = None
    for name, failing in checks:
        row = failing.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def running_position(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def run_lengths(rows: DataFrame, group: Sequence[str], order: str, bad: Column) -> DataFrame:
    """Length of the run of consecutive bad rows that ends at each row."""
    w = Window.partitionBy(*group).orderBy(order)
    block = F.sum(F.when(bad, 0).otherwise(1)).over(w)
    marked = rows.withColumn("_bad", bad.cast("int")).withColumn("_block", block)
    return marked.withColumn("bad_run", F.sum("_bad").over(Window.partitionBy(*group, "_block").orderBy(order))).drop("_bad", "_block")

"""Splits for training and test: groups dealt by size, and pairs of texts that no two splits share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed
from millrace.functions.text import collapse, normalize, text_key, words_of
from millrace.operators.corpus import hash_order
from millrace.operators.ranks import running_sum

# The splits in the order in which they win ties, with their shares.
SPLITS = (("train", 0.70), ("val", 0.15), ("test", 0.15))
LEAST_WORDS = 6


def _greedy(splits: Sequence[tuple[str, float]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group goes to the split that lacks the largest share of its target; only the sums of one source are held."""
    source, filled = None, [0] * len(splits)
    for batch in batches:
        chosen = []
        for row in batch.itertuples():
            if row.source != source:
                source, filled = row.source, [int(n) for n in row.begun]
            lacks = [1 - n / (share * row.total) for n, (_, share) in zip(filled, splits)]
            best = lacks.index(max(lacks))
            filled[best] += int(row.rows)
            chosen.append(splits[best][0])
        yield batch[["source", "group", "rows"]].assign(split=chosen)


def deal_groups(rows: DataFrame, source: str, group: str, forced: DataFrame | None = None, splits: Sequence[tuple[str, float]] = SPLITS, seed: str = "group") -> DataFrame:
    """(source, group, rows, split): the groups of each source, the largest first, towards the shares of the splits.

    Groups of ``forced`` (group, split) keep their split and count towards it. Equal sizes go by hash. Null names
    count as empty ones. The choice is sequential by definition: a task reads one row a group in order, not the rows.
    """
    named = rows.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"))
    sizes = named.groupBy("source", "group").agg(F.count("*").alias("rows"))
    if forced is None:
        forced = rows.sparkSession.createDataFrame([], "group string, split string")
    met = sizes.join(forced.select(F.col("group").cast("string").alias("group"), "split"), "group", "left")
    sums = met.groupBy("source").agg(F.sum("rows").alias("total"), F.array(*(F.sum(F.when(F.col("split") == s, F.col("rows")).otherwise(0)) for s, _ in splits)).alias("begun"))
    ordered = met.where("split is null").join(sums, "source").withColumn("h", hash_order(seed, F.col("source"), F.col("group"))).repartition("source").sortWithinPartitions("source", F.desc("rows"), "h", "group")
    dealt = ordered.select("source", "group", "rows", "total", "begun").mapInPandas(partial(_greedy, tuple(splits)), "source string, `group` string, rows long, split string")
    return dealt.unionByName(met.where("split is not null").select("source", "group", "rows", "split"))


def split_projects(projects: DataFrame, name: str, test: int = 2, val: int = 1, seed: str = "dependency_project") -> DataFrame:
    """(name, split): projects in hash order, the first to the test, the next to validation, the others to training."""
    placed = running_sum(projects.select(name).distinct().withColumn("_h", hash_order(seed, F.col(name))), ["_h", name], "_n")
    place = F.col("_n")
    return placed.select(name, F.when(place <= test, "test").when(place <= test + val, "val").otherwise("train").alias("split"))


def related_pairs(relations: DataFrame, texts: DataFrame, master: DataFrame, splits: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``relations`` (project, left, right) with ``split``, digests of both texts' keys and ``dropped``, which is null for pairs to keep.

    ``texts`` are (id, text), ``master`` holds the known ``text_key``, ``splits`` are (project, split). A pair goes if
    a text is missing, short or unknown, or if a text of it also occurs in training (or, from validation, in the test).
    """
    digest = lambda key: F.unhex(F.sha2(key, 256))
    known = texts.select("id", digest(text_key(normalize(F.col("text")))).alias("key"), F.size(words_of(collapse(F.col("text")))).alias("words"))
    known = checkpointed(known.join(master.select(digest(F.col("text_key")).alias("key"), F.lit(True).alias("listed")).distinct(), "key", "left"))
    sides = {s: known.select(F.col("id").alias(s), F.col("key").alias(f"{s}_key"), F.col("words").alias(f"{s}_words"), F.coalesce("listed", F.lit(False)).alias(f"{s}_listed")) for s in ("left", "right")}
    rows = relations.join(splits, "project")
    for s, side in sides.items():
        rows = rows.join(side, s, "left")
    reason = (
        F.when(F.col("left_key").isNull() | F.col("right_key").isNull(), "text_missing")
        .when(F.least("left_words", "right_words") < least, "short_text")
        .when(~(F.col("left_listed") & F.col("right_listed")), "not_in_master")
    )
    judged = rows.withColumn("reason", reason)
    used = judged.where("reason is null").select("split", F.explode(F.array("left_key", "right_key")).alias("key"))
    held = used.groupBy("key").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") == "test").alias("test"))
    for s in sides:
        judged = judged.join(held.select(F.col("key").alias(f"{s}_key"), F.col("train").alias(f"{s}_train"), F.col("test").alias(f"{s}_test")), f"{s}_key", "left")
    dropped = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when((F.col("split") != "train") & (F.col("left_train") | F.col("right_train")), "text_in_train")
        .when((F.col("split") == "val") & (F.col("left_test") | F.col("right_test")), "text_in_test")
    )
    return judged.select(*relations.columns, "split", "left_key", "right_key", dropped.alias("dropped"))

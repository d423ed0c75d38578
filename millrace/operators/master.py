"""One corpus from many sources: what becomes of each row, which sources hold copies of it, and whose labels disagree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed
from millrace.functions.text import normalize, text_key
from millrace.operators.similarity import vector_top_k
from millrace.operators.splits import LEAST_WORDS

FATES = ("master", "collapsed", "dup_dropped", "conflict_moved", "dropped_empty")


def fates(rows: DataFrame, canonical: Mapping[str, str], least: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (id, source, text, label) as (id, source, fate, copies, also_in, conflict).

    Within a source, equal normalised texts with one label leave the row with the smallest id (``dup_dropped``), with
    several labels, a missing one counting as one, none (``conflict_moved``). Rows of a source in ``canonical`` go where the source it names
    keeps the same text (``collapsed``); the rows there name such sources in ``also_in``. ``conflict`` tells of master
    rows whether labels of the text differ between sources (``least`` words or more) or within one.
    Ids are unique; null sources and texts count as empty ones. Groups are settled by aggregation, never gathered; texts and
    their keys move as digests.
    """
    text = normalize(F.coalesce("text", F.lit("")))
    named = rows.select("id", F.coalesce("source", F.lit("")).alias("source"), text.alias("norm"), "label")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    own = text_key(F.col("norm"))
    keyed = named.select("id", "source", digest("norm").alias("same"), F.when(own != "", digest(own)).alias("key"), F.size(F.split("norm", " ")).alias("words"), "label")
    keyed = checkpointed(keyed)  # one pass over the texts
    labels = F.count_distinct("label") + F.max(F.col("label").isNull().cast("int"))
    groups = keyed.where("key is not null").groupBy("source", "same").agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.min("id").alias("first"), F.count("*").alias("copies"), F.min("label").alias("label"), labels.alias("labels")
    )
    kept = groups.where("labels = 1")
    home = F.lit(None).cast("string")
    for derived, source in canonical.items():
        home = F.when(F.col("source") == derived, source).otherwise(home)
    homes = kept.where(F.col("source").isin(*set(canonical.values()))).select(F.col("source").alias("home"), "key", F.lit(True).alias("held")).distinct()
    placed = kept.withColumn("home", home).join(homes, ["home", "key"], "left")
    copies = placed.where("held").groupBy(F.col("home").alias("source"), "key").agg(F.array_join(F.sort_array(F.collect_set("source")), ";").alias("also_in"))
    across = kept.where((F.col("words") >= least) & F.col("label").isNotNull()).groupBy("key").agg(F.count_distinct("source").alias("s"), F.count_distinct("label").alias("l"))
    across = across.where("s > 1 and l > 1").select("key", F.lit("cross_source").alias("across"))
    within = groups.where("labels > 1").select("key", F.lit("within_source").alias("within")).distinct()
    settled = placed.join(copies, ["source", "key"], "left").join(across, "key", "left").join(within, "key", "left")
    settled = settled.select("source", "same", "first", "copies", "held", "also_in", F.concat_ws(";", "across", "within").alias("conflict"))
    out = keyed.select("id", "source", "same", F.col("key").isNull().alias("empty")).join(settled, ["source", "same"], "left")
    fate = (
        F.when(F.col("empty"), "dropped_empty").when(F.col("first").isNull(), "conflict_moved").when(F.col("id") != F.col("first"), "dup_dropped")
        .when(F.col("held"), "collapsed").otherwise("master")
    )
    told = out.withColumn("fate", fate)
    main = F.col("fate") == "master"
    return told.select("id", "source", "fate", *(F.when(main, F.col(c)).alias(c) for c in ("copies", "also_in")), F.when(main & (F.col("conflict") != ""), F.col("conflict")).alias("conflict"))


def fate_report(told: DataFrame) -> DataFrame:
    """(source, rows_in, one column for each fate) of the result of ``fates``."""
    return told.groupBy("source").agg(F.count("*").alias("rows_in"), *(F.count_if(F.col("fate") == f).alias(f) for f in FATES))


def overlap_audit(left: DataFrame, right: DataFrame, k: int = 3, threshold: float = 0.8) -> DataFrame:
    """(query, target, score, rank): of each row of ``left`` the ``k`` nearest of ``right`` (both id, vector), from ``threshold`` on.

    The two sides share no id.
    """
    return vector_top_k(right, left, k).where(F.col("score") >= threshold)

"""Traceability links: upserts that keep history, decay, completeness, categories and read models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import clamp

KEY = ("source_id", "target_id")


def by_ends(new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``new`` (source_id, target_id, ...) whose ends are both in ``nodes`` (id), and the others, with ``missing``: the
    ends that they lack. Rows with a null end lack it."""
    ends = nodes.select("id").where("id is not null").distinct()
    both = new.join(ends.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(ends.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("_s").isNull(), "source_id"), F.when(F.col("_t").isNull(), "target_id")))
    marked = both.withColumn("missing", F.array_join(missing, ","))
    return marked.where("missing = ''").select(*new.columns), marked.where("missing <> ''").select(*new.columns, "missing")


def upsert(links: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` with ``new`` (source_id, target_id, confidence, at) merged in.

    A known link keeps ``verified_at``, takes the new confidence and ``last_checked_at`` and is verified again; a new
    one starts now. A link that lacks an end in ``nodes`` (id) is refused: the whole write is an error, as ``by_ends`` tells
    such links before.
    """
    good, refused = by_ends(new, nodes)
    name = F.concat_ws(" -> ", F.coalesce(F.col("source_id").cast("string"), F.lit("null")), F.coalesce(F.col("target_id").cast("string"), F.lit("null")))
    error = F.raise_error(F.concat(F.lit("link without its ends: "), name)).cast(new.schema["confidence"].dataType)
    good = good.unionByName(refused.drop("missing").withColumn("confidence", error))
    fresh = good.select(*KEY, F.col("confidence").alias("_c"), F.col("at").alias("_at"))
    both = links.join(fresh, list(KEY), "full_outer")
    return both.select(
        *KEY,
        F.coalesce("_c", "confidence").alias("confidence"),
        F.when(F.col("_at").isNotNull(), "verified").otherwise(F.col("status")).alias("status"),
        F.coalesce("verified_at", "_at").alias("verified_at"),
        F.coalesce("_at", "last_checked_at").alias("last_checked_at"),
    )


def mark_decayed(links: DataFrame, decayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the ``decayed`` (source_id, target_id, reason, at) marked, never deleted, and the flags to append."""
    hit = decayed.select(*KEY, F.col("reason").alias("_r"), F.col("at").alias("_at"))
    joined = links.join(hit, list(KEY), "left")
    out = joined.select(*KEY, "confidence", F.when(F.col("_r").isNotNull(), "decayed").otherwise(F.col("status")).alias("status"), "verified_at", F.coalesce("_at", "last_checked_at").alias("last_checked_at"))
    flags = links.select(*KEY).join(hit, list(KEY)).select(*KEY, F.col("_r").alias("reason"), F.col("_at").alias("flagged_at"))
    return out, flags


def decay_candidates(links: DataFrame, texts: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Verified links whose stored hash is no longer that of their texts, limited to ``changed`` targets if given.

    ``links`` have source_id, target_id, status and text_hash; ``texts`` have id and text_hash of one end each.
    """
    scope = links.where("status = 'verified'")
    if changed is not None:
        scope = scope.join(changed.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    now = texts.select(F.col("id").alias("target_id"), F.col("text_hash").alias("current_hash"))
    return scope.join(now, "target_id").where(~F.col("text_hash").eqNullSafe(F.col("current_hash")))


def completeness(requirements: DataFrame, links: DataFrame) -> DataFrame:
    """Trace score, orphan flag and completeness of each requirement (id, evidence): decayed links do not count.

    With evidence the score is 0.6 trace + 0.4 evidence (held to 0..1), without it the trace alone; in percent.
    """
    own = links.where("status = 'verified'").groupBy(F.col("source_id").alias("id")).agg(F.avg("confidence").alias("trace"), F.count("*").alias("n_links"))
    joined = requirements.join(own, "id", "left").na.fill(0.0, ["trace"]).na.fill(0, ["n_links"])
    score = F.when(F.col("evidence").isNull(), F.col("trace")).otherwise(0.6 * F.col("trace") + 0.4 * clamp(F.col("evidence")))
    return joined.withColumn("orphan", F.col("n_links") == 0).withColumn("completeness", F.bround(score * 100, 2))


def orphans(requirements: DataFrame, links: DataFrame) -> DataFrame:
    return requirements.join(links.where("status = 'verified'").select(F.col("source_id").alias("id")), "id", "left_anti")


def run_categories(shortlist: DataFrame, verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """Category of every pair that was shortlisted or is true: verified right or wrong, rejected, missed, pending."""
    key = ["query", "target"]
    both = shortlist.select(*key, F.lit(True).alias("_s")).join(truth.select(*key, F.lit(True).alias("_t")), key, "full_outer").join(verdicts, key, "left")
    listed, true = F.col("_s").isNotNull(), F.col("_t").isNotNull()
    kind = (
        F.when(~listed, "missed")
        .when(F.col("accepted").isNull(), "pending")
        .when(F.col("accepted") & true, "verified_correct")
        .when(F.col("accepted"), "verified_wrong")
        .when(true, "rejected_true")
        .otherwise("rejected")
    )
    return both.select(*key, kind.alias("category"))


def export_nodes(frames: Sequence[DataFrame]) -> DataFrame:
    """Nodes (id, label, properties) of several frames, later frames win where ids repeat."""
    all_ = None
    for number, frame in enumerate(frames):
        part = frame.withColumn("_o", F.lit(number))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("id").agg(F.max_by(F.struct("label", "properties"), "_o").alias("_r")).select("id", "_r.label", "_r.properties")


def export_edges(frames: Sequence[DataFrame]) -> DataFrame:
    """Edges (source, target, type, properties) of several frames, earlier frames win where keys repeat."""
    all_ = None
    for number, frame in enumerate(frames):
        part = frame.withColumn("_o", F.lit(number))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("source", "target", "type").agg(F.min_by("properties", "_o").alias("properties"))


def last_entries(history: DataFrame, group: Sequence[str], order: str, keep: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return history.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def run_summary(events: DataFrame) -> DataFrame:
    """Totals of each run from its event log (run, type, seconds)."""
    return events.groupBy("run").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "verified").alias("verified"),
        F.count_if(F.col("type") == "rejected").alias("rejected"),
        F.avg(F.when(F.col("type").isin("verified", "rejected"), F.col("seconds"))).alias("mean_seconds"),
    )

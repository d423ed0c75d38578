"""Change history: package and file churn, snapshots and what changed between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import mean_of, ratio, symmetric_change


def package_evolution(log: DataFrame, by: Sequence[str], current: DataFrame | None = None) -> DataFrame:
    """Distinct commits, contributors and files, insertions, deletions and churn of each package.

    ``log`` has commit_id, author, file_path, insertions and deletions. Packages of ``current`` without a change get
    zeros; ``activity`` says whether a package changed and is still there.
    """
    own = log.groupBy(*by).agg(
        F.count_distinct("commit_id").alias("commit_count"),
        F.count_distinct("author").alias("contributor_count"),
        F.count_distinct("file_path").alias("files_changed"),
        F.coalesce(F.sum("insertions"), F.lit(0)).alias("total_insertions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletions"),
    )
    counts = [c for c in own.columns if c not in by]
    if current is not None:
        own = own.join(current.select(*by, F.lit(True).alias("_now")), list(by), "full_outer").na.fill(0, counts)
        active = F.when(F.col("_now").isNull(), "historical_only").when(F.col("commit_count") > 0, "active").otherwise("unchanged")
        own = own.withColumn("activity", active).drop("_now")
    return own.withColumn("total_churn", F.col("total_insertions") + F.col("total_deletions"))


def split_rollup(rows: DataFrame, by: Sequence[str], production: Column, measures: Sequence[str]) -> DataFrame:
    """Sums of the measures apart for production and test rows, and the production mean (zero without rows)."""
    out = []
    for name, keep in (("production", production), ("test", ~production)):
        out += [F.count_if(keep).alias(f"{name}_files"), *(F.coalesce(F.sum(F.when(keep, F.col(m))), F.lit(0)).alias(f"{name}_{m}") for m in measures)]
    summed = rows.groupBy(*by).agg(*out)
    return summed.withColumns({f"mean_{m}": ratio(F.col(f"production_{m}"), F.col("production_files")).cast("double") for m in measures})


def snapshot_pairs(snapshots: DataFrame, group: Sequence[str], date: str) -> DataFrame:
    """Adjacent snapshot dates of each group's own calendar: (group, previous, current)."""
    order = Window.partitionBy(*group).orderBy(date)
    dates = snapshots.select(*group, date).distinct().withColumn("current", F.lead(date).over(order))
    return dates.where("current is not null").withColumnRenamed(date, "previous")


def lagged(rows: DataFrame, key: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    """The columns at the key's own previous snapshot, which may not be the calendar's."""
    order = Window.partitionBy(*key).orderBy(date)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(order) for c in (date, *columns)})


def package_changes(metrics: DataFrame, pairs: DataFrame, group: Sequence[str], package: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Every package of either snapshot of a pair: status, both values and their delta (null unless both are there)."""
    old = pairs.join(metrics.withColumnRenamed(date, "previous"), [*group, "previous"]).select(*group, "previous", "current", package, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(1).alias("_o"))
    new = pairs.join(metrics.withColumnRenamed(date, "current"), [*group, "current"]).select(*group, "previous", "current", package, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(1).alias("_n"))
    both = old.join(new, [*group, "previous", "current", package], "full_outer")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("retained")
    return both.withColumn("change_status", status).withColumns({f"{c}_delta": F.col(f"new_{c}") - F.col(f"old_{c}") for c in columns}).drop("_o", "_n")


def change_proxy(changes: DataFrame, columns: Sequence[str], threshold: float = 0.30) -> DataFrame:
    """Retained packages with the mean of their symmetric relative changes and whether it reaches the threshold."""
    mean = mean_of([symmetric_change(F.col(f"old_{c}").cast("double"), F.col(f"new_{c}").cast("double")) for c in columns])
    kept = changes.where("change_status = 'retained'").withColumn("mean_change", mean)
    return kept.withColumn("proxy", F.when(F.col("mean_change").isNotNull(), (F.col("mean_change") >= threshold).cast("int")))


def change_report(proxies: DataFrame, by: Sequence[str]) -> DataFrame:
    return proxies.groupBy(*by).agg(F.count("*").alias("examples"), F.count_if(F.col("proxy") == 1).alias("positive"), F.count_if(F.col("proxy") == 0).alias("negative"), F.avg("mean_change").alias("mean_change"))


def graph_changes(edges: DataFrame, pairs: DataFrame, group: Sequence[str], date: str) -> DataFrame:
    """(group, previous, current, src, dst, was, is): edges of either snapshot of each pair."""
    old = pairs.join(edges.withColumnRenamed(date, "previous"), [*group, "previous"]).select(*group, "previous", "current", "src", "dst", F.lit(1).alias("was"))
    new = pairs.join(edges.withColumnRenamed(date, "current"), [*group, "current"]).select(*group, "previous", "current", "src", "dst", F.lit(1).alias("now"))
    return old.join(new, [*group, "previous", "current", "src", "dst"], "full_outer").na.fill(0, ["was", "now"])


def architecture_change(package_rows: DataFrame, edge_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packages and edges added, removed and common, both Jaccard similarities (1 for two empty sets) and the score."""
    p = package_rows.groupBy(*by).agg(
        F.count_if(F.col("change_status") == "added").alias("packages_added"),
        F.count_if(F.col("change_status") == "removed").alias("packages_removed"),
        F.count_if(F.col("change_status") == "retained").alias("common_packages"),
    )
    e = edge_rows.groupBy(*by).agg(F.sum(F.col("now") * (1 - F.col("was"))).alias("edges_added"), F.sum(F.col("was") * (1 - F.col("now"))).alias("edges_removed"), F.sum(F.col("was") * F.col("now")).alias("common_edges"))
    both = p.join(e, list(by), "left").na.fill(0, ["edges_added", "edges_removed", "common_edges"])

    def jaccard(kind: str) -> Column:
        common = F.col(f"common_{kind}")
        return ratio(common, common + F.col(f"{kind}_added") + F.col(f"{kind}_removed"), 1.0)

    both = both.withColumn("package_jaccard", jaccard("packages")).withColumn("edge_jaccard", jaccard("edges"))
    return both.withColumn("change_score", ((1 - F.col("package_jaccard")) + (1 - F.col("edge_jaccard"))) / 2)


def incident_changes(edge_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges added and removed at each package, at whichever end it is."""
    ends = edge_rows.withColumn("node", F.explode(F.array_distinct(F.array("src", "dst"))))
    return ends.groupBy(*by, "node").agg(F.sum(F.col("now") * (1 - F.col("was"))).alias("edges_added"), F.sum(F.col("was") * (1 - F.col("now"))).alias("edges_removed"))


def snapshot_flags(snapshots: DataFrame, packages: str, files: str, least_packages: int = 5, least_files: int = 10) -> DataFrame:
    flags = F.concat_ws("; ", F.when(F.col(packages) < least_packages, "few_packages"), F.when(F.col(files) < least_files, "few_files"))
    return snapshots.withColumn("quality_flag", F.when(flags == "", "ok").otherwise(flags))


def interval_quality(changes: DataFrame, by: Sequence[str], least_retention: float = 0.5, least_rows: int = 20) -> DataFrame:
    """Retention of each interval, its flags, and whether it may be used for training."""
    counts = changes.groupBy(*by).agg(*(F.count_if(F.col("change_status") == s).alias(s) for s in ("retained", "added", "removed")), F.count("*").alias("rows"))
    rated = counts.withColumn("retention_rate", ratio(F.col("retained"), F.col("retained") + F.col("removed")))
    low, small = F.col("retention_rate") < least_retention, F.col("rows") < least_rows
    reason = F.concat_ws("; ", F.when(low, "low_retention"), F.when(small, "small_snapshot"))
    return rated.withColumn("review_reason", reason).withColumn("eligible", ~low & (F.col("retained") >= least_rows))


def union_of_keys(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str, str]) -> DataFrame:
    """All keys of either side with ``origin``: in both, in the left only, in the right only."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(key), "full_outer")
    origin = F.when(F.col("_r").isNull(), names[1]).when(F.col("_l").isNull(), names[2]).otherwise(names[0])
    return both.withColumn("origin", origin).drop("_l", "_r")


def availability(rows: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """A flag for each group of columns, set if all of them are there, and how many groups are."""
    for name, columns in groups.items():
        every = F.lit(True)
        for c in columns:
            every &= F.col(c).isNotNull()
        rows = rows.withColumn(f"has_{name}", every)
    return rows.withColumn("groups_available", sum((F.col(f"has_{n}").cast("int") for n in groups), F.lit(0)))


def evenly_spaced(rows: DataFrame, group: Sequence[str], date: str, count: int = 4) -> DataFrame:
    """Up to ``count`` snapshots of each group at evenly spaced places, first and last included."""
    order = Window.partitionBy(*group).orderBy(date)
    dates = rows.select(*group, date).distinct()
    placed = dates.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    wanted = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    hit = F.bround(F.col("_k") * (F.col("_n") - 1) / (count - 1)).cast("long") == F.col("_i")
    return wanted.where(hit).select(*group, date).distinct()

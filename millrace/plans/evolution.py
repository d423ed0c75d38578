"""Events are the change log; parts by year of shipping are the snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evolution as evo
from millrace.plans.registry import Catalog, read

catalog = Catalog()
MIDDLE = "2024-01-16"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    whole = F.floor(F.abs("value")).cast("long")
    return e.select(
        F.col("ts"),
        F.col("event_id").alias("commit_id"),
        F.col("event_type").alias("package"),
        F.col("user_id").alias("author"),
        F.get_json_object("props", "$.k").alias("file_path"),
        F.when(F.col("event_id") % 2 == 0, whole).otherwise(0).alias("insertions"),
        F.when(F.col("event_id") % 2 == 1, whole).otherwise(0).alias("deletions"),
    )


LOG_SQL = """l AS (SELECT ts, event_id AS commit_id, event_type AS package, user_id AS author, json_extract_string(props, '$.k') AS file_path,
  CASE WHEN event_id % 2 = 0 THEN floor(abs(value))::BIGINT ELSE 0 END AS insertions, CASE WHEN event_id % 2 = 1 THEN floor(abs(value))::BIGINT ELSE 0 END AS deletions
  FROM events)"""
SUMS_SQL = "count(DISTINCT commit_id) AS commit_count, count(DISTINCT author) AS contributor_count, count(DISTINCT file_path) AS files_changed, coalesce(sum(insertions), 0)::BIGINT AS total_insertions, coalesce(sum(deletions), 0)::BIGINT AS total_deletions, coalesce(sum(insertions + deletions), 0)::BIGINT AS total_churn"


@catalog.add(f"WITH {LOG_SQL} SELECT package, {SUMS_SQL} FROM l GROUP BY package")
def evolution_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.package_evolution(log(spark, sf_dir), ["package"])


@catalog.add(f"WITH {LOG_SQL} SELECT author, {SUMS_SQL} FROM l GROUP BY author")
def evolution_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.package_evolution(log(spark, sf_dir), ["author"])


@catalog.add(f"WITH {LOG_SQL} SELECT {SUMS_SQL} FROM l")
def evolution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.package_evolution(log(spark, sf_dir), [])


@catalog.add(
    f"""WITH {LOG_SQL}, c AS (SELECT DISTINCT event_type AS package, user_id AS author FROM events WHERE ts >= TIMESTAMP '{MIDDLE}'),
o AS (SELECT package, author, {SUMS_SQL} FROM l WHERE ts < TIMESTAMP '{MIDDLE}' GROUP BY package, author)
SELECT coalesce(o.package, c.package) AS package, coalesce(o.author, c.author) AS author, coalesce(commit_count, 0) AS commit_count, coalesce(contributor_count, 0) AS contributor_count, coalesce(files_changed, 0) AS files_changed,
  coalesce(total_insertions, 0) AS total_insertions, coalesce(total_deletions, 0) AS total_deletions, coalesce(total_churn, 0) AS total_churn,
  CASE WHEN c.package IS NULL THEN 'historical_only' WHEN commit_count > 0 THEN 'active' ELSE 'unchanged' END AS activity
FROM o FULL JOIN c ON o.package = c.package AND o.author = c.author"""
)
def evolution_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History is what lies before the middle of the log, the inventory what occurs from there on."""
    early = F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz")
    rows = log(spark, sf_dir)
    return evo.package_evolution(rows.where(early), ["package", "author"], rows.where(~early).select("package", "author").distinct())


@catalog.add(
    f"""WITH {LOG_SQL}, s AS (SELECT package, author, count(*) AS commits, sum(insertions + deletions)::BIGINT AS churn FROM l GROUP BY 1, 2)
SELECT package, count(*) FILTER (WHERE author % 2 = 0) AS production_files, coalesce(sum(commits) FILTER (WHERE author % 2 = 0), 0)::BIGINT AS production_commits, coalesce(sum(churn) FILTER (WHERE author % 2 = 0), 0)::BIGINT AS production_churn,
  count(*) FILTER (WHERE author % 2 = 1) AS test_files, coalesce(sum(commits) FILTER (WHERE author % 2 = 1), 0)::BIGINT AS test_commits, coalesce(sum(churn) FILTER (WHERE author % 2 = 1), 0)::BIGINT AS test_churn,
  round(sum(commits) FILTER (WHERE author % 2 = 0) / count(*) FILTER (WHERE author % 2 = 0), 6) AS mean_commits, round(sum(churn) FILTER (WHERE author % 2 = 0) / count(*) FILTER (WHERE author % 2 = 0), 6) AS mean_churn
FROM s GROUP BY package"""
)
def production_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = log(spark, sf_dir).groupBy("package", "author").agg(F.count("*").alias("commits"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"))
    out = evo.split_rollup(files, ["package"], F.col("author") % 2 == 0, ["commits", "churn"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_commits", "mean_churn")})


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each part (package) for each ship year: rows, suppliers, whole quantity."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("package"), "l_suppkey", "l_quantity", F.year("l_shipdate").alias("year"))
    return lines.groupBy("year", "package").agg(F.count("*").alias("files"), F.count_distinct("l_suppkey").alias("coupling"), F.sum(F.col("l_quantity").cast("long")).alias("loc"))


SNAP_SQL = """s AS (SELECT year(l_shipdate)::INT AS year, 'P' || l_partkey AS package, count(*) AS files, count(DISTINCT l_suppkey) AS coupling, sum(l_quantity::BIGINT)::BIGINT AS loc
  FROM lineitem GROUP BY 1, 2)"""
PAIRS_SQL = "p AS (SELECT * FROM (SELECT year AS previous, lead(year) OVER (ORDER BY year) AS current FROM (SELECT DISTINCT year FROM s)) WHERE current IS NOT NULL)"
MEASURES = ("files", "coupling", "loc")


def _pairs(snaps: DataFrame, date: str = "year") -> DataFrame:
    return evo.snapshot_pairs(snaps.withColumn("repository", F.lit("all")), ["repository"], date)


@catalog.add(f"WITH {SNAP_SQL}, {PAIRS_SQL} SELECT previous, current FROM p")
def snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(snapshots(spark, sf_dir)).select("previous", "current")


@catalog.add(
    f"""WITH {SNAP_SQL} SELECT year, package, lag(year) OVER w AS previous_year, lag(files) OVER w AS previous_files, lag(coupling) OVER w AS previous_coupling
FROM s WINDOW w AS (PARTITION BY package ORDER BY year)"""
)
def package_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.lagged(snapshots(spark, sf_dir), ["package"], "year", ["files", "coupling"]).select("year", "package", "previous_year", "previous_files", "previous_coupling")


CHANGES_SQL = """c AS (SELECT coalesce(o.previous, n.previous) AS previous, coalesce(o.current, n.current) AS current, coalesce(o.package, n.package) AS package,
  CASE WHEN o.package IS NULL THEN 'added' WHEN n.package IS NULL THEN 'removed' ELSE 'retained' END AS change_status,
  o.files AS old_files, n.files AS new_files, o.coupling AS old_coupling, n.coupling AS new_coupling, o.loc AS old_loc, n.loc AS new_loc
  FROM (SELECT p.*, package, files, coupling, loc FROM p JOIN s ON s.year = previous) o FULL JOIN (SELECT p.*, package, files, coupling, loc FROM p JOIN s ON s.year = current) n
  ON o.previous = n.previous AND o.package = n.package)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir).withColumn("repository", F.lit("all"))
    return evo.package_changes(snaps, _pairs(snaps), ["repository"], "package", "year", MEASURES)


@catalog.add(f"WITH {SNAP_SQL}, {PAIRS_SQL}, {CHANGES_SQL} SELECT previous, current, package, change_status, new_files - old_files AS files_delta, new_coupling - old_coupling AS coupling_delta, new_loc - old_loc AS loc_delta FROM c")
def package_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("previous", "current", "package", "change_status", "files_delta", "coupling_delta", "loc_delta")


def _sym(c: str) -> str:
    return f"CASE WHEN old_{c} + new_{c} = 0 THEN 0.0 ELSE abs(new_{c} - old_{c})::DOUBLE / (old_{c} + new_{c}) END"


PROXY_SQL = f"x AS (SELECT *, ({' + '.join(_sym(c) for c in MEASURES)}) / 3 AS mean_change FROM c WHERE change_status = 'retained')"


@catalog.add(f"WITH {SNAP_SQL}, {PAIRS_SQL}, {CHANGES_SQL}, {PROXY_SQL} SELECT previous, current, package, round(mean_change, 6) AS mean_change, (mean_change >= 0.3)::INT AS proxy FROM x")
def change_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.change_proxy(_changes(spark, sf_dir), MEASURES).select("previous", "current", "package", F.round("mean_change", 6).alias("mean_change"), "proxy")


@catalog.add(f"WITH {SNAP_SQL}, {PAIRS_SQL}, {CHANGES_SQL}, {PROXY_SQL} SELECT previous, current, count(*) AS examples, count(*) FILTER (WHERE mean_change >= 0.3) AS positive, count(*) FILTER (WHERE mean_change < 0.3) AS negative, round(avg(mean_change), 6) AS mean_change FROM x GROUP BY 1, 2")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evo.change_report(evo.change_proxy(_changes(spark, sf_dir), MEASURES), ["previous", "current"])
    return report.withColumn("mean_change", F.round("mean_change", 6))


def yearly_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges part -> nation of a supplier of each ship year."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit("P"), "l_partkey").alias("src"), F.year("l_shipdate").alias("year"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("year", "src", "dst").distinct().withColumn("repository", F.lit("all"))


EDGE_SQL = """e AS (SELECT DISTINCT year(l_shipdate)::INT AS year, 'P' || l_partkey AS src, 'N' || s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT coalesce(o.previous, n.previous) AS previous, coalesce(o.current, n.current) AS current, coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, (o.src IS NOT NULL)::INT AS was, (n.src IS NOT NULL)::INT AS now
  FROM (SELECT p.*, src, dst FROM p JOIN e ON e.year = previous) o FULL JOIN (SELECT p.*, src, dst FROM p JOIN e ON e.year = current) n ON o.previous = n.previous AND o.src = n.src AND o.dst = n.dst)"""


def _edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.graph_changes(yearly_edges(spark, sf_dir), _pairs(snapshots(spark, sf_dir)), ["repository"], "year")


@catalog.add(
    f"""WITH {SNAP_SQL}, {PAIRS_SQL}, {CHANGES_SQL}, {EDGE_SQL},
a AS (SELECT previous, current, count(*) FILTER (WHERE change_status = 'added') AS packages_added, count(*) FILTER (WHERE change_status = 'removed') AS packages_removed, count(*) FILTER (WHERE change_status = 'retained') AS common_packages FROM c GROUP BY 1, 2),
b AS (SELECT previous, current, sum(now * (1 - was))::BIGINT AS edges_added, sum(was * (1 - now))::BIGINT AS edges_removed, sum(was * now)::BIGINT AS common_edges FROM g GROUP BY 1, 2),
j AS (SELECT a.*, coalesce(edges_added, 0) AS edges_added, coalesce(edges_removed, 0) AS edges_removed, coalesce(common_edges, 0) AS common_edges FROM a LEFT JOIN b USING (previous, current)),
k AS (SELECT *, CASE WHEN common_packages + packages_added + packages_removed = 0 THEN 1 ELSE common_packages / (common_packages + packages_added + packages_removed) END AS pj,
  CASE WHEN common_edges + edges_added + edges_removed = 0 THEN 1 ELSE common_edges / (common_edges + edges_added + edges_removed) END AS ej FROM j)
SELECT previous, current, packages_added, packages_removed, common_packages, edges_added, edges_removed, common_edges, round(pj, 6) AS package_jaccard, round(ej, 6) AS edge_jaccard, round(((1 - pj) + (1 - ej)) / 2, 6) AS change_score FROM k"""
)
def snapshot_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evo.architecture_change(_changes(spark, sf_dir), _edge_changes(spark, sf_dir), ["previous", "current"])
    return out.withColumns({c: F.round(c, 6) for c in ("package_jaccard", "edge_jaccard", "change_score")})


@catalog.add(
    f"""WITH {SNAP_SQL}, {PAIRS_SQL}, {EDGE_SQL}, d AS (SELECT previous, current, src AS node, was, now FROM g UNION ALL SELECT previous, current, dst, was, now FROM g WHERE src <> dst)
SELECT previous, current, node, sum(now * (1 - was))::BIGINT AS edges_added, sum(was * (1 - now))::BIGINT AS edges_removed FROM d GROUP BY 1, 2, 3"""
)
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.incident_changes(_edge_changes(spark, sf_dir), ["previous", "current"])


@catalog.add(
    f"""WITH {SNAP_SQL} SELECT year, count(*) AS packages, sum(files)::BIGINT AS files,
  CASE WHEN count(*) < 26 AND sum(files) < 3000 THEN 'few_packages; few_files' WHEN count(*) < 26 THEN 'few_packages' WHEN sum(files) < 3000 THEN 'few_files' ELSE 'ok' END AS quality_flag FROM s GROUP BY year"""
)
def snapshot_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = snapshots(spark, sf_dir).groupBy("year").agg(F.count("*").alias("packages"), F.sum("files").alias("files"))
    return evo.snapshot_flags(counts, "packages", "files", 26, 3000)


@catalog.add(
    f"""WITH {SNAP_SQL}, {PAIRS_SQL}, {CHANGES_SQL}, t AS (SELECT previous, current, count(*) FILTER (WHERE change_status = 'retained') AS retained, count(*) FILTER (WHERE change_status = 'added') AS added, count(*) FILTER (WHERE change_status = 'removed') AS removed, count(*) AS rows FROM c GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN retained + removed = 0 THEN 0 ELSE retained / (retained + removed) END AS rate FROM t)
SELECT previous, current, retained, added, removed, rows, round(rate, 6) AS retention_rate, concat_ws('; ', CASE WHEN rate < 0.5 THEN 'low_retention' END, CASE WHEN rows < 20 THEN 'small_snapshot' END) AS review_reason, NOT rate < 0.5 AND retained >= 20 AS eligible FROM u"""
)
def interval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evo.interval_quality(_changes(spark, sf_dir), ["previous", "current"]).withColumn("retention_rate", F.round("retention_rate", 6))


@catalog.add(
    """WITH a AS (SELECT p_brand AS package, count(*) AS files FROM part WHERE p_size <= 25 GROUP BY 1),
b AS (SELECT p_brand AS package, count(*) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1995 AND p_retailprice > 1500 GROUP BY 1)
SELECT coalesce(a.package, b.package) AS package, files, sold, CASE WHEN b.package IS NULL THEN 'structural_only' WHEN a.package IS NULL THEN 'dependency_only' ELSE 'structural_dependency' END AS origin FROM a FULL JOIN b ON a.package = b.package"""
)
def dataset_union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    left = part.where("p_size <= 25").groupBy(F.col("p_brand").alias("package")).agg(F.count("*").alias("files"))
    lines = read(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == 1995).join(part.where("p_retailprice > 1500"), F.col("l_partkey") == F.col("p_partkey"))
    right = lines.groupBy(F.col("p_brand").alias("package")).agg(F.count("*").alias("sold"))
    return evo.union_of_keys(left, right, ["package"], ("structural_dependency", "structural_only", "dependency_only"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("n_chars"))
    return docs.join(labels, "doc_id", "left")


FEATURE_SQL = "f AS (SELECT doc_id, lang, source, CASE WHEN n_chars > 1000 THEN n_chars END AS n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)), h AS (SELECT *, n_chars IS NOT NULL AS has_size, quality IS NOT NULL AND n_chars IS NOT NULL AS has_label, lang IS NOT NULL AND source IS NOT NULL AS has_meta FROM f)"


@catalog.add(f"WITH {FEATURE_SQL} SELECT doc_id, has_size, has_label, has_meta, has_size::INT + has_label::INT + has_meta::INT AS groups_available FROM h")
def dep_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = evo.availability(_features(spark, sf_dir), {"size": ["n_chars"], "label": ["quality", "n_chars"], "meta": ["lang", "source"]})
    return flags.select("doc_id", "has_size", "has_label", "has_meta", "groups_available")


@catalog.add(f"WITH {FEATURE_SQL} SELECT has_size, has_label, lang, count(*) AS documents, grouping(has_size, has_label, lang)::BIGINT AS level FROM h GROUP BY CUBE (has_size, has_label, lang)")
def availability_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = evo.availability(_features(spark, sf_dir), {"size": ["n_chars"], "label": ["quality", "n_chars"]})
    return flags.cube("has_size", "has_label", "lang").agg(F.count("*").alias("documents"), F.grouping_id().alias("level"))


@catalog.add(
    """WITH d AS (SELECT DISTINCT o_orderstatus AS repository, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY repository) AS n FROM d)
SELECT DISTINCT repository, month FROM r, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE round_even(k * (n - 1) / 3.0, 0)::BIGINT = i"""
)
def snapshot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("repository"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return evo.evenly_spaced(months, ["repository"], "month")

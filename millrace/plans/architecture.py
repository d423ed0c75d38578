"""Packages are nations, a dependency is a supplier's nation delivering to a customer's nation.

Over all deliveries every nation delivers to every other, so a package depends on its strongest partners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import architecture as arch
from millrace.operators import graph
from millrace.plans.registry import Catalog, read

catalog = Catalog()
STRONG = 8
STRONGEST = 3


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivery: names of the two nations."""
    nation = read(spark, sf_dir, "nation")
    source, target = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("s_nationkey", "src"), ("c_nationkey", "dst")))
    return (
        read(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(source, "s_nationkey")
        .join(target, "c_nationkey")
        .select("src", "dst")
    )


def edges(spark: SparkSession, sf_dir: str, partners: int) -> DataFrame:
    """Each nation's so many strongest partners by deliveries."""
    counts = occurrences(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    best = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= partners).select("src", "dst")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))


def occurrence_sql(partners: int) -> str:
    return f"""o AS (SELECT sn.n_name AS src, cn.n_name AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey),
e AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS place FROM o WHERE src <> dst GROUP BY src, dst) WHERE place <= {partners})"""


METRICS_SQL = """m AS (SELECT n_name AS node, coalesce(i.n, 0) AS fan_in, coalesce(u.n, 0) AS fan_out, coalesce(i.n, 0) + coalesce(u.n, 0) AS total_coupling,
  CASE WHEN coalesce(i.n, 0) + coalesce(u.n, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(u.n, 0)::DOUBLE / (coalesce(i.n, 0) + coalesce(u.n, 0)) END AS instability
  FROM nation LEFT JOIN (SELECT dst, count(*) n FROM e GROUP BY dst) i ON i.dst = n_name LEFT JOIN (SELECT src, count(*) n FROM e GROUP BY src) u ON u.src = n_name)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines of each package: suppliers and the whole part of their balances."""
    own = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("files"), F.sum(F.floor(F.abs("s_acctbal"))).alias("lines"))
    named = read(spark, sf_dir, "nation").join(own, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return named.select(F.col("n_name").alias("node"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("lines", F.lit(0)).alias("lines"))


SIZES_SQL = """z AS (SELECT n_name AS node, coalesce(files, 0) AS files, coalesce(lines, 0)::BIGINT AS lines FROM nation
  LEFT JOIN (SELECT s_nationkey, count(*) AS files, sum(floor(abs(s_acctbal))) AS lines FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey)"""


@catalog.add(f"WITH {occurrence_sql(STRONG)}, {METRICS_SQL}, {SIZES_SQL} SELECT node, files, lines, fan_in, fan_out, total_coupling, round(instability, 6) AS instability FROM m JOIN z USING (node)")
def package_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = graph.degrees(sizes(spark, sf_dir), edges(spark, sf_dir, STRONG))
    return metrics.withColumn("instability", F.round("instability", 6))


RISK_SQL = (
    "r AS (SELECT *, "
    + ", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER () AS {c}_rank" for c in ("total_coupling", "instability", "lines"))
    + " FROM m JOIN z USING (node)), s AS (SELECT *, round(total_coupling_rank * 0.4::DOUBLE + instability_rank * 0.35::DOUBLE + lines_rank * 0.25::DOUBLE, 6) AS risk_score FROM r)"
)


@catalog.add(
    f"""WITH {occurrence_sql(STRONG)}, {METRICS_SQL}, {SIZES_SQL}, {RISK_SQL}
SELECT node, total_coupling, lines, round(instability, 6) AS instability, risk_score,
  CASE WHEN risk_score <= 0.5 THEN 'Low' WHEN risk_score <= 0.8 THEN 'Medium' WHEN risk_score <= 1.0 THEN 'High' END AS risk_level FROM s"""
)
def package_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = graph.degrees(sizes(spark, sf_dir), edges(spark, sf_dir, STRONG))
    scored = arch.risk(metrics, {"total_coupling": 0.40, "instability": 0.35, "lines": 0.25})
    return scored.select("node", "total_coupling", "lines", F.round("instability", 6).alias("instability"), "risk_score", "risk_level")


@catalog.add(
    f"""WITH {occurrence_sql(STRONG)}, k AS (SELECT n_name FROM nation WHERE n_regionkey < 3)
SELECT count(*) FILTER (WHERE src = dst) AS self_rows, 0::BIGINT AS blank_rows,
  count(*) FILTER (WHERE src <> dst AND NOT (src IN (FROM k) AND dst IN (FROM k))) AS outside_rows,
  count(DISTINCT CASE WHEN src <> dst AND src IN (FROM k) AND dst IN (FROM k) THEN src || '>' || dst END) AS accepted_edges FROM o"""
)
def scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("node"))
    return arch.scope_audit(occurrences(spark, sf_dir), known)


@catalog.add(
    f"""WITH {occurrence_sql(STRONG)}, l AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT src, dst, a.r_name AS source_layer, b.r_name AS target_layer FROM e JOIN l a ON src = a.n_name JOIN l b ON dst = b.n_name
WHERE a.r_name <> b.r_name AND a.r_name > b.r_name"""
)
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    layers = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("layer"))
    a, b = region.select(F.col("r_name").alias("source_layer")), region.select(F.col("r_name").alias("target_layer"))
    allowed = a.join(b, F.col("source_layer") <= F.col("target_layer"))
    return arch.layer_violations(edges(spark, sf_dir, STRONG), layers, allowed)


PREFIXES = (("http:", "plain"), ("https:", "secure"), ("https://www", "site"), ("https://blog", "blog"))


@catalog.add(
    """WITH r(prefix, layer) AS (VALUES ('http:', 'plain'), ('https:', 'secure'), ('https://www', 'site'), ('https://blog', 'blog')),
p AS (SELECT page_id, split_part(url, '.', 1) AS head, url FROM pages),
m AS (SELECT page_id, arg_max(layer, length(prefix)) AS layer, max(length(prefix)) AS n FROM p JOIN r ON starts_with(head || '/', prefix || '/') GROUP BY page_id)
SELECT coalesce(layer, 'none') AS layer, count(*) AS pages FROM p LEFT JOIN m USING (page_id) GROUP BY 1"""
)
def layer_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PREFIXES, "prefix string, layer string")
    pages = read(spark, sf_dir, "pages").select("page_id", F.substring_index("url", ".", 1).alias("head"))
    return arch.longest_prefix(pages, "page_id", "head", rules, "/").groupBy(F.coalesce("layer", F.lit("none")).alias("layer")).agg(F.count("*").alias("pages"))


@catalog.add(
    f"""WITH {occurrence_sql(STRONGEST)}, {METRICS_SQL}
SELECT format('COUPLING-{{:03d}}', row_number() OVER (ORDER BY node)) AS finding_id, node, total_coupling, 4 AS threshold,
  CASE WHEN total_coupling >= 8 THEN 'High' ELSE 'Medium' END AS severity FROM m WHERE total_coupling >= 4"""
)
def coupling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir, STRONGEST))
    return arch.coupling_findings(metrics).select("finding_id", "node", "total_coupling", "threshold", "severity")


@catalog.add(f"WITH {occurrence_sql(STRONG)}, {METRICS_SQL} SELECT node, fan_in, fan_out, total_coupling FROM m")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir, STRONG)).select("node", "fan_in", "fan_out", "total_coupling")


RANK_ROUNDS = 40
PAGERANK_SQL = (
    f"WITH {occurrence_sql(STRONGEST)}, u AS (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT n_name AS node, 1.0::DOUBLE / count(*) OVER () AS rank FROM nation), "
    + ", ".join(
        f"""r{k} AS MATERIALIZED (SELECT r.node, 0.15::DOUBLE / (SELECT count(*) FROM nation) + 0.85::DOUBLE * coalesce((SELECT sum(rank) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM u)), 0) / (SELECT count(*) FROM nation)
  + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM r{k - 1} r LEFT JOIN (SELECT dst, sum(q.rank / u.n) AS given FROM e JOIN u USING (src) JOIN r{k - 1} q ON q.node = e.src GROUP BY dst) g ON g.dst = r.node)"""
        for k in range(1, RANK_ROUNDS + 1)
    )
    + f" SELECT node, round(rank, 4) AS rank FROM r{RANK_ROUNDS}"
)


@catalog.add(PAGERANK_SQL)
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(nodes(spark, sf_dir), edges(spark, sf_dir, STRONGEST), tolerance=1e-7)
    return ranks.select("node", F.round("rank", 4).alias("rank"))


@catalog.add(
    f"""WITH RECURSIVE {occurrence_sql(1)}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, root) AS (SELECT n_name, n_name FROM nation UNION SELECT b.dst, r.root FROM r JOIN b ON r.node = b.src),
l AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT node, root, dense_rank() OVER (ORDER BY root) - 1 AS component_id FROM l"""
)
def graph_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(nodes(spark, sf_dir), edges(spark, sf_dir, 1))


REACH_SQL = f"""WITH RECURSIVE {occurrence_sql(STRONGEST)},
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
c AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a),
l AS (SELECT node, min(other) AS root FROM c GROUP BY node)"""


@catalog.add(f"{REACH_SQL} SELECT n_name AS node, coalesce(root, n_name) AS root FROM nation LEFT JOIN l ON node = n_name")
def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph.strong_components(nodes(spark, sf_dir), edges(spark, sf_dir, STRONGEST))
    least = parts.groupBy("root").agg(F.min("node").alias("least"))
    return parts.join(least, "root").select("node", F.col("least").alias("root"))


@catalog.add(
    f"""{REACH_SQL}, g AS (SELECT root, string_agg(node, ';' ORDER BY node) AS members, count(*) AS size FROM l GROUP BY root HAVING count(*) > 1)
SELECT members, size, (SELECT count(*) FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst WHERE a.root = g.root AND b.root = g.root) AS internal_edges FROM g"""
)
def cycle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(nodes(spark, sf_dir), edges(spark, sf_dir, STRONGEST))


@catalog.add(
    f"""WITH RECURSIVE {occurrence_sql(STRONGEST)},
p(s, v, d, n) AS (SELECT n_name, n_name, 0, 1.0::DOUBLE FROM nation
  UNION ALL SELECT s, v, d, sum(n) FROM (SELECT p.s, e.dst AS v, p.d + 1 AS d, p.n FROM p JOIN e ON p.v = e.src WHERE p.d < 24) GROUP BY s, v, d),
m AS (SELECT s, v, min(d) AS d FROM p GROUP BY s, v), q AS (SELECT s, v, d, sum(n) AS n FROM p JOIN m USING (s, v, d) GROUP BY s, v, d)
SELECT n_name AS node, round(coalesce(sum(a.n * b.n / c.n), 0) / (24.0 * 23.0), 6) AS betweenness FROM nation
LEFT JOIN (q a JOIN q b ON a.v = b.s JOIN q c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d AND a.s <> a.v AND b.s <> b.v) ON a.v = n_name GROUP BY n_name"""
)
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.betweenness(nodes(spark, sf_dir), edges(spark, sf_dir, STRONGEST)).select("node", F.round("betweenness", 6).alias("betweenness"))

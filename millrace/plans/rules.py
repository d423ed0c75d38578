"""Decision rules, strict joins, ranked lists and samples over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.operators import rules
from millrace.plans import similarity
from millrace.plans.registry import Catalog, read

catalog = Catalog()
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the two halves of each text: what is expected and what is there."""
    docs = read(spark, sf_dir, "documents")
    half = "length(text) div 2"
    return docs.select("doc_id", fn.tokens(F.expr(f"left(text, {half})")).alias("expected"), fn.tokens(F.expr(f"substring(text, {half} + 1)")).alias("actual"))


@catalog.add(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format('left(text, length(text) // 2)')} AS e, {_WORDS.format('substr(text, length(text) // 2 + 1)')} AS a FROM documents)
SELECT doc_id, round(CASE WHEN len(e) = 0 THEN 1.0 ELSE least(1.0, len(list_intersect(e, a)) / len(e) / 0.45) END, 6) AS aligned FROM w"""
)
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("doc_id", F.round(rules.alignment(F.col("expected"), F.col("actual")), 6).alias("aligned"))


_ANY = lambda text, terms: "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"
KINDS = ("NEGATIVE", "BOUNDARY", "STATE", "POSITIVE")
NAMES = ("the", "and", "les", "nicht")


@catalog.add(
    f"""WITH t AS (SELECT doc_id, n_chars % 4 AS k, lower(text) AS low FROM documents)
SELECT doc_id, round(CASE k WHEN 0 THEN CASE WHEN {_ANY('low', rules.NEGATIVE_TERMS)} THEN 1 ELSE 0.25 END WHEN 1 THEN ({' + '.join(f"contains(low, '{n}')::INT" for n in NAMES)}) / 4
  WHEN 2 THEN CASE WHEN {_ANY('low', rules.STATE_TERMS)} THEN 1 ELSE 0.4 END ELSE 1 END::DOUBLE, 6) AS aligned FROM t WHERE low IS NOT NULL"""
)
def scenario_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.round(rules.scenario_alignment(kind, F.array(*map(F.lit, NAMES)), F.col("text")), 6).alias("aligned"))


@catalog.add(
    f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 > 0 THEN 1.0 ELSE 0.3 END WHEN trim(coalesce(text, '')) = '' THEN 0.0
  WHEN lower(trim(text)) IN ({', '.join(f"'{w}'" for w in rules.WEAK_ORACLES)}) THEN 0.2 WHEN len({_WORDS.format('trim(text)')}) >= 4 THEN 0.9 ELSE 0.6 END::DOUBLE AS strength FROM conversations"""
)
def oracle_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "AUTOMATED_TEST").otherwise("MANUAL_TEST")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", rules.oracle_strength(kind, F.col("turn") % 3, F.col("text")).alias("strength"))


@catalog.add("SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL AND trim(source) NOT IN ('', 'src0', 'pending') GROUP BY 1")
def unambiguous_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.unambiguous(read(spark, sf_dir, "documents"), "source", (*rules.AMBIGUOUS, "src0"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"))


@catalog.add("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.optional(read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@catalog.add(
    """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.08) AS cheap, CASE WHEN count(*) < 7 THEN count(*) FILTER (WHERE l_quantity > 45) END AS large FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN large IS NOT NULL THEN (returned + cheap + large >= 2)::INT END AS label FROM c"""
)
def violation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large lines of full orders (seven lines) count as not measured."""
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.08).alias("cheap"), F.when(F.count("*") < 7, F.count_if(F.col("l_quantity") > 45)).alias("large"))
    return own.select("l_orderkey", rules.violation_label([F.col("returned"), F.col("cheap"), F.col("large")], 2).alias("label"))


@catalog.add("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return rules.strict_left_join(read(spark, sf_dir, "supplier"), nation, ["s_nationkey"]).groupBy("n_name").agg(F.count("*").alias("suppliers"))


@catalog.add(
    """WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority || o_orderstatus))) AS m FROM orders GROUP BY 1),
u AS (SELECT m, min(o_custkey) AS matched FROM s GROUP BY m HAVING count(*) = 1) SELECT o_custkey, matched FROM s JOIN u USING (m)"""
)
def same_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose set of priorities and states no other customer has."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.concat("o_orderpriority", "o_orderstatus").alias("kind"))
    return rules.same_sets(rows, rows, "o_custkey", "kind")


@catalog.add("SELECT unnest(string_split(coalesce(source || ';' || lang, 'missing'), ';')) AS reason, count(*) AS rows FROM documents GROUP BY 1")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.concat("source", F.lit(";"), "lang").alias("reasons"))
    return rules.reason_counts(rows, "reasons")


@catalog.add("SELECT p_partkey, p_size AS size_factor, '{\"p_size\":' || p_size || ',\"p_partkey\":' || p_partkey || '}' AS factors FROM part")
def factor_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, json = rules.factors(["p_size", "p_partkey"])
    return read(spark, sf_dir, "part").select("p_partkey", named["p_size"].cast("int").alias("size_factor"), json.alias("factors"))


@catalog.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 50)


@catalog.add("SELECT c_custkey AS requirement_id, round(c_acctbal / 100, 2) AS rvc_percent FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 5000 ORDER BY c_acctbal / 100, c_custkey LIMIT 6")
def priority_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk, status = F.when(F.col("c_mktsegment") == "BUILDING", "HIGH").otherwise("LOW"), F.when(F.col("c_acctbal") < 5000, "PARTIAL").otherwise("ADEQUATE")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requirement_id"), risk.alias("risk"), status.alias("status"), (F.col("c_acctbal") / 100).alias("rvc_percent"))
    return rules.priority_list(rows).select("requirement_id", F.round("rvc_percent", 2).alias("rvc_percent"))


_SEVERITY = {"O": "HIGH", "P": "MEDIUM", "F": "LOW"}


@catalog.add(
    """WITH g AS (SELECT o_custkey AS requirement_id, o_orderpriority AS gap_type, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank, o_orderkey AS rvu_id FROM orders),
f AS (SELECT requirement_id, gap_type, min(row(rank, rvu_id)) AS r FROM g GROUP BY 1, 2), h AS (SELECT f.requirement_id, f.gap_type, g.rank, g.rvu_id FROM f JOIN g ON g.requirement_id = f.requirement_id AND g.gap_type = f.gap_type AND row(g.rank, g.rvu_id) = f.r)
SELECT requirement_id, gap_type, rvu_id, CASE rank WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM h ORDER BY rank, requirement_id, gap_type LIMIT 8"""
)
def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "O", "HIGH").when(F.col("o_orderstatus") == "P", "MEDIUM").otherwise("LOW")
    return rules.gap_list(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderpriority").alias("gap_type"), severity.alias("severity"), F.col("o_orderkey").alias("rvu_id")))


ADVICE = (("N", "Keep it", "watch"), ("R", "Returned often", "inspect"))


@catalog.add(
    """WITH x AS (SELECT l_suppkey AS package, l_returnflag AS feature, round(avg(l_discount) - 0.049, 6) AS shap_value FROM lineitem GROUP BY 1, 2), r(feature, title, action) AS (VALUES ('N', 'Keep it', 'watch'), ('R', 'Returned often', 'inspect'))
SELECT package, feature, title, action, shap_value, row_number() OVER (PARTITION BY package ORDER BY shap_value DESC, feature)::INT AS place, CASE WHEN shap_value >= 0.004 THEN 'High' ELSE 'Medium' END AS priority FROM x JOIN r USING (feature) WHERE shap_value > 0"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("package"), F.col("l_returnflag").alias("feature")).agg(F.round(F.avg("l_discount") - 0.049, 6).alias("shap_value"))
    return rules.recommendations(found, spark.createDataFrame(ADVICE, "feature string, title string, action string"), ["package"], high=0.004)


@catalog.add(
    """WITH n AS (SELECT source, count(*) < 12 AS sparse FROM documents GROUP BY 1), h AS (SELECT d.doc_id, d.source, sparse, md5('spot:' || d.doc_id) AS h FROM documents d JOIN n ON d.source = n.source),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place FROM h), t AS (SELECT *, CASE WHEN place = 1 THEN 0 WHEN sparse AND place IN (2, 3) THEN 1 WHEN NOT sparse AND place = 2 THEN 2 END AS tier FROM p)
SELECT doc_id, source, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, h, doc_id LIMIT 100"""
)
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.join(docs.groupBy("source").agg((F.count("*") < 12).alias("sparse")), "source")
    return rules.spot_check(rows, "source", "doc_id", F.col("sparse")).select("doc_id", "source", "tier")


@catalog.add(
    f"""WITH {similarity.PAIR_SQL}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3 - 1e-7), q AS (SELECT *, a || '|' || b AS pid FROM p),
t AS (SELECT * FROM q ORDER BY cosine DESC, pid LIMIT 25), s AS (SELECT * FROM q WHERE cosine >= 0.3 AND cosine < 0.5 AND pid NOT IN (SELECT pid FROM t) ORDER BY md5('review_band:' || pid) LIMIT 25)
SELECT a, b, cosine, 'top' AS selection FROM t UNION ALL SELECT a, b, cosine, 'band' FROM s"""
)
def review_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.similarity import similarity_join

    pairs = similarity_join(similarity.vectors(spark, sf_dir), 0.3).select(F.col("left").alias("a"), F.col("right").alias("b"), F.round("score", 6).alias("cosine"))
    return rules.review_bands(pairs, band=(0.3, 0.5)).select("a", "b", "cosine", "selection")


_CHANGED = {
    "unrelated_replacement": f"'{rules.UNRELATED}'",
    "negate_behavior": r"replace(replace(regexp_replace(text, '\bshall\b', 'shall not', 'g'), '==', '!='), 'True', 'False')",
    "change_numbers": r"regexp_replace(regexp_replace(text, '(\d+)', '\107', 'g'), '\b0+(\d)', '\1', 'g')",
    "cosmetic_control": "text || chr(10) || '(Reformatted; no functional change.)'",
}


@catalog.add(
    f"""WITH m AS ({' UNION ALL '.join(f"SELECT item_id, '{n}' AS mutation, text, {sql} AS mutated FROM benchmark" for n, sql in _CHANGED.items())}),
w AS (SELECT mutation, {_WORDS.format('text')} AS a, {_WORDS.format('mutated')} AS b FROM m WHERE text <> mutated), o AS (SELECT mutation, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.8 AS decayed FROM w)
SELECT count(*) FILTER (WHERE mutation <> 'cosmetic_control') AS injected, count(*) FILTER (WHERE mutation <> 'cosmetic_control' AND decayed) AS detected,
  round(coalesce(avg(decayed::INT) FILTER (WHERE mutation <> 'cosmetic_control'), 0), 6) AS decay_detection_accuracy, round(coalesce(avg(decayed::INT) FILTER (WHERE mutation = 'cosmetic_control'), 0), 6) AS false_decay_rate FROM o"""
)
def decay_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed items decay where they share less than 0.8 of their words with what they were."""
    changed = F.array(*(F.struct(F.lit(n).alias("mutation"), c.alias("mutated")) for n, c in rules.mutations(F.col("text")).items() if n in _CHANGED))
    rows = read(spark, sf_dir, "benchmark").select("text", F.inline(changed)).where("text <> mutated")
    outcomes = rows.select("mutation", (fn.jaccard(fn.tokens(F.col("text")), fn.tokens(F.col("mutated"))) < 0.8).alias("decayed"))
    return rules.decay_accuracy(outcomes).withColumns({c: F.round(c, 6) for c in ("decay_detection_accuracy", "false_decay_rate")})


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and orders as nodes, who ordered what as edges; the segment is the project."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Requirement").alias("label"), F.col("c_mktsegment").alias("project"))
    nodes = nodes.unionByName(orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("Code").alias("label"), F.lit(None).cast("string").alias("project")))
    return nodes, orders.select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"))


@catalog.add("SELECT c_mktsegment AS project, count(*) AS artifacts FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def graph_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.projects(rules.artifacts(_graph(spark, sf_dir)[0]))


@catalog.add(
    """WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), e AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM k))
SELECT (SELECT count(*) FROM k) AS requirements, (SELECT count(*) FROM e) AS code, (SELECT count(*) FROM e) AS edges"""
)
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on the customers in debt, over finished orders."""
    nodes, edges = _graph(spark, sf_dir)
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    inside, touched = rules.subgraph(nodes, rules.traces(edges, status="F"), poor)
    counts = inside.agg(F.count_if(F.col("label") == "Requirement").alias("requirements"), F.count_if(F.col("label") == "Code").alias("code"))
    return counts.crossJoin(touched.agg(F.count("*").alias("edges")))

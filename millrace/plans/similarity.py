"""Benchmark items look for documents; vectors look for vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators import similarity as sim
from millrace.plans.registry import Catalog, read

catalog = Catalog()
STOP = ("the", "of", "and", "in", "to", "is")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _tokens(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), lambda x: x NOT IN {STOP})"


KEYWORD_SQL = f"""qk AS (SELECT item_id AS query, len(t) AS qn, unnest(t) AS w FROM (SELECT item_id, {_tokens('text')} AS t FROM benchmark)),
tk AS (SELECT doc_id AS target, len(t) AS tn, unnest(t) AS w FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)),
ks AS (SELECT query, target, count(*) / (any_value(qn) + any_value(tn) - count(*)) AS score FROM qk JOIN tk USING (w) GROUP BY 1, 2)"""


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN {STOP})"


TFIDF_SQL = f"""tx AS (SELECT 'q' AS side, item_id AS id, unnest({_terms('text')}) AS term FROM benchmark UNION ALL SELECT 't', doc_id, unnest({_terms('text')}) FROM documents),
tf AS (SELECT side, id, term, count(*) AS tf FROM tx GROUP BY 1, 2, 3), nn AS (SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) AS n),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, nn GROUP BY term), rw AS (SELECT side, id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
wt AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM rw),
ts AS (SELECT a.id AS query, b.id AS target, sum(a.w * b.w) AS score FROM wt a JOIN wt b USING (term) WHERE a.side = 'q' AND b.side = 't' GROUP BY 1, 2)"""


def _top(of: str, k: int) -> str:
    return f"SELECT query, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM (SELECT query, target, round(score, 6) AS score FROM {of})) WHERE rank <= {k}"


@catalog.add(f"WITH {KEYWORD_SQL} {_top('ks', 5)}")
def keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.top_k(sim.keyword_scores(queries(spark, sf_dir), targets(spark, sf_dir), STOP), 5)


@catalog.add(f"WITH {TFIDF_SQL} {_top('ts', 5)}")
def tfidf_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.top_k(sim.tfidf_scores(queries(spark, sf_dir), targets(spark, sf_dir), STOP), 5)


def _z(of: str) -> str:
    return f"(SELECT query, target, score, sum(score) OVER p / (SELECT count(*) FROM documents) AS m, sum(score * score) OVER p / (SELECT count(*) FROM documents) AS s FROM {of} WINDOW p AS (PARTITION BY query))"


@catalog.add(
    f"""WITH {KEYWORD_SQL}, {TFIDF_SQL}, z AS (SELECT query, target, score / (sqrt(greatest(s - m * m, 0)) + 1e-9) AS gain, -m / (sqrt(greatest(s - m * m, 0)) + 1e-9) AS nothing, 'k' AS method FROM {_z('ks')}
  UNION ALL SELECT query, target, score / (sqrt(greatest(s - m * m, 0)) + 1e-9), -m / (sqrt(greatest(s - m * m, 0)) + 1e-9), 't' FROM {_z('ts')}),
f AS (SELECT query, sum(nothing) AS floor FROM (SELECT query, method, any_value(nothing) AS nothing FROM z GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT query, target, sum(gain) + any_value(floor) AS score FROM z JOIN f USING (query) GROUP BY 1, 2) SELECT query, target, rank FROM ({_top('h', 3)})"""
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = queries(spark, sf_dir), targets(spark, sf_dir)
    fused = sim.fuse([sim.keyword_scores(q, t, STOP), sim.tfidf_scores(q, t, STOP)], t.count())
    return sim.top_k(fused, 3).select("query", "target", "rank")


@catalog.add(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' '), lambda x: x <> '') AS w, text FROM documents),
c AS (SELECT doc_id, CASE WHEN len(w) <= 60 THEN [text] ELSE list_transform(range(1, len(w) + 1, 45), lambda i: array_to_string(w[i:i + 59], ' ')) END AS c FROM w),
p AS (SELECT doc_id, n, c[n] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS n FROM c)),
tk AS (SELECT doc_id AS target, n, len(t) AS tn, unnest(t) AS w FROM (SELECT doc_id, n, {_tokens('text')} AS t FROM p)), qk AS (SELECT item_id AS query, len(t) AS qn, unnest(t) AS w FROM (SELECT item_id, {_tokens('text')} AS t FROM benchmark)),
s AS (SELECT query, target, n, count(*) / (any_value(qn) + any_value(tn) - count(*)) AS score FROM qk JOIN tk USING (w) GROUP BY 1, 2, 3), b AS (SELECT query, target, max(score) AS score FROM s GROUP BY 1, 2) {_top('b', 3)}"""
)
def chunk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.candidates(queries(spark, sf_dir), targets(spark, sf_dir), "keyword", 3, stop=STOP)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


PAIR_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"


@catalog.add(f"WITH {PAIR_SQL}, s AS (SELECT a.id AS query, b.id AS target, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0) {_top('s', 5)}")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vectors(spark, sf_dir)
    return sim.vector_top_k(table, table.where("id % 50 = 0"), 5)


@catalog.add(f"WITH {PAIR_SQL} SELECT a.id AS \"left\", b.id AS \"right\", round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.35 - 1e-7")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.similarity_join(vectors(spark, sf_dir), 0.35).withColumn("score", F.round("score", 6))


@catalog.add(
    f"""WITH RECURSIVE {PAIR_SQL}, l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4 - 1e-7),
r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a), g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT node, root, dense_rank() OVER (ORDER BY root) - 1 AS component_id FROM g"""
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sim.similarity_join(vectors(spark, sf_dir), 0.4).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.weak_components(nodes, pairs)


@catalog.add(
    """WITH m AS (SELECT label, d, avg(x) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2)
SELECT label, d::INT AS dim, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS value FROM m"""
)
def package_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.centroids(vectors(spark, sf_dir), "label").withColumn("value", F.round("value", 6))

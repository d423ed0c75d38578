"""A corpus from the sources of documents and from events, and what two sets of vectors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import learn, master
from millrace.plans.registry import Catalog, read
from millrace.plans.similarity import PAIR_SQL, _top, vectors

catalog = Catalog()


def _fates_sql(rows: str, canonical: dict[str, str], least: int) -> str:
    """``rows``: a query for id, source, text and label."""
    homes = ", ".join(f"('{a}', '{b}')" for a, b in canonical.items())
    norm = "lower(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '^\"(.*)\"$', '\\1'))"
    return f"""WITH c(derived, home) AS (VALUES {homes}), n AS (SELECT id, coalesce(source, '') AS source, {norm} AS norm, label FROM ({rows})),
k AS (SELECT *, regexp_replace(norm, '[^a-z0-9]', '', 'g') AS key, len(string_split(norm, ' ')) AS words FROM n),
g AS (SELECT source, norm, key, words, min(id) AS first, count(*) AS copies, min(label) AS label, count(DISTINCT label) + max((label IS NULL)::INT) AS labels FROM k WHERE key <> '' GROUP BY ALL),
p AS (SELECT g.*, home, EXISTS (SELECT 1 FROM g h WHERE h.source = home AND h.key = g.key AND h.labels = 1) AS held FROM g LEFT JOIN c ON derived = g.source WHERE labels = 1),
a AS (SELECT home AS source, key, string_agg(DISTINCT source, ';' ORDER BY source) AS also_in FROM p WHERE held GROUP BY ALL),
x AS (SELECT key FROM p WHERE words >= {least} AND label IS NOT NULL GROUP BY key HAVING count(DISTINCT source) > 1 AND count(DISTINCT label) > 1),
r AS (SELECT id, k.source, k.key, CASE WHEN k.key = '' THEN 'dropped_empty' WHEN p.first IS NULL THEN 'conflict_moved' WHEN id <> p.first THEN 'dup_dropped' WHEN held THEN 'collapsed' ELSE 'master' END AS fate, copies
  FROM k LEFT JOIN p ON p.source = k.source AND p.norm = k.norm)
SELECT id, r.source, fate, CASE WHEN fate = 'master' THEN copies END AS copies, CASE WHEN fate = 'master' THEN also_in END AS also_in,
  CASE WHEN fate = 'master' THEN nullif(concat_ws(';', CASE WHEN r.key IN (SELECT key FROM x) THEN 'cross_source' END, CASE WHEN r.key IN (SELECT key FROM g WHERE labels > 1) THEN 'within_source' END), '') END AS conflict
FROM r LEFT JOIN a ON a.source = r.source AND a.key = r.key"""


DOCUMENT_HOMES = {"src1": "src0", "src2": "src0"}
EVENT_HOMES = {"view": "purchase"}
DOCUMENTS = "SELECT doc_id AS id, source, text, lang AS label FROM documents"
EVENTS = "SELECT event_id AS id, event_type AS source, props || ' of user ' || user_id AS text, CASE WHEN value >= 25 THEN 'high' WHEN value >= 1 THEN 'low' END AS label FROM events"


@catalog.add(_fates_sql(DOCUMENTS, DOCUMENT_HOMES, 6))
def master_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.col("lang").alias("label"))
    return master.fates(rows, DOCUMENT_HOMES)


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("value") >= 25, "high").when(F.col("value") >= 1, "low")
    text = F.concat("props", F.lit(" of user "), "user_id")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), text.alias("text"), label.alias("label"))


@catalog.add(_fates_sql(EVENTS, EVENT_HOMES, 5))
def master_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few texts, many copies: all fates but the empty one occur."""
    return master.fates(event_texts(spark, sf_dir), EVENT_HOMES, 5)


@catalog.add(f"WITH f AS ({_fates_sql(EVENTS, EVENT_HOMES, 5)}) SELECT source, count(*) AS rows_in, {', '.join(f'count(*) FILTER (fate = {chr(39)}{f}{chr(39)}) AS {f}' for f in master.FATES)} FROM f GROUP BY source")
def master_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.fate_report(master.fates(event_texts(spark, sf_dir), EVENT_HOMES, 5))


@catalog.add(f"WITH {PAIR_SQL}, s AS (SELECT a.id AS query, b.id AS target, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.label < 5 AND b.label >= 5), t AS ({_top('s', 3)}) SELECT * FROM t WHERE score >= 0.3")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a label below five against all others."""
    table = vectors(spark, sf_dir)
    return master.overlap_audit(table.where("label < 5"), table.where("label >= 5"), threshold=0.3)


@catalog.add()
def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of a fifth of the labelled documents, by one model a label from the others."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    models = learn.one_vs_rest(rows.where(~held), ["quality", "toxic"])
    return learn.labels_of(models, rows.where(held)).select("doc_id", "quality_pred", "toxic_pred")

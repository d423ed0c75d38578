"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, lexical, linededup, mixing, sharding, simhash, spelling, styletree, substrings, surrogates, urlfilter, vectors
from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taught = docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    scored = langid.predict(docs.select("doc_id", "text"), langid.train(taught))
    return scored.select("doc.doc_id", langid.held_out("doc.doc_id").alias("held_out"), "language.*")


SURROGATE_KEY = b"a deployment brings its own key"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return rows.select("doc_id", "n_replaced", "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
             sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM r),
lam AS (SELECT arg_min(total - capped, place)::DOUBLE AS rest, arg_min(heavy, place)::DOUBLE AS heavy FROM l
        WHERE 3.0 * source_size * heavy >= (total - capped) * weight),
t AS (SELECT r.source, r.source_size, least(lam.rest * r.weight / lam.heavy, (3 * r.source_size)::DOUBLE) AS target FROM r, lam),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target,
             CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM c
"""


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, n, string_split(coalesce(text, ''), chr(10))[n] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)),
k AS (SELECT doc_id, n, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY doc_id
"""


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", "item_id", "item_words", "edits", "end_word")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, x, substr(h, 2 * x - 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS x FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.x FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.low),
i AS (SELECT doc_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 50 THEN 0 ELSE 1 END AS new FROM g),
j AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY x) AS k FROM i),
r AS (SELECT doc_id, k, min(x) AS a, max(x) + 50 AS b FROM j GROUP BY doc_id, k),
p AS (SELECT d.doc_id, h, a, b, lag(b, 1, 1) OVER (PARTITION BY d.doc_id ORDER BY a) AS since FROM d JOIN r ON d.doc_id = r.doc_id),
q AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
             string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) - 1) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(q.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (SELECT DISTINCT item_id, term
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
i AS (SELECT f.doc_id, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS impact
      FROM f JOIN w ON f.term = w.term JOIN d ON f.doc_id = d.doc_id, s),
c AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i ON q.term = i.term GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.noisy_words(table(spark, sf_dir, "documents")))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = styletree.main_texts(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Query]:
    return {"op1_simhash": op1_simhash, "op2_langid": op2_langid, "op3_surrogates": op3_surrogates, "op4_mixing": op4_mixing, "op5_linededup": op5_linededup, "op6_urlfilter": op6_urlfilter, "op7_decontaminate": op7_decontaminate, "op8_vectors": op8_vectors, "op9_sharding": op9_sharding, "op10_substrings": op10_substrings, "op11_lexical": op11_lexical, "op12_spelling": op12_spelling, "op13_html": op13_html}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_linededup": OP5_SQL, "op8_vectors": OP8_SQL, "op10_substrings": OP10_SQL, "op11_lexical": OP11_SQL}

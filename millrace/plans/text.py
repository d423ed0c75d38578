"""Text operators over documents and benchmark items, with word lists that occur in these texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import encoding
from millrace.functions import text as fn
from millrace.operators import corpus, requirements
from millrace.plans.registry import Catalog, read

catalog = Catalog()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", "text")


WS = "'[ \\t\\n\\r\\f\\x0B]+'"
COLLAPSED = f"trim(regexp_replace(text, {WS}, ' ', 'g'))"


@catalog.add(f"SELECT doc_id, sha256({COLLAPSED}) AS content, length({COLLAPSED}) AS chars, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS text_key FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(fn.text_key(F.col("text")), 256)
    return _docs(spark, sf_dir).select("doc_id", fn.content_hash(F.col("text")).alias("content"), F.length(fn.collapse(F.col("text"))).cast("long").alias("chars"), key.alias("text_key"))


_KEYWORDS = ", ".join(f"'{w}'" for w in fn.CODE_WORDS)


@catalog.add(
    f"""WITH w AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN ({_KEYWORDS})) AS words FROM pages)
SELECT page_id, len(words)::BIGINT AS n_words, md5(array_to_string(words, ' ')) AS words FROM w"""
)
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fn.identifier_words(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ").cast("binary")).alias("words"))


STOP = ("the", "of", "and", "in", "to", "is")


@catalog.add(
    f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens
FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN {STOP}) AS t FROM documents)"""
)
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fn.tokens(F.col("text"), STOP)
    return _docs(spark, sf_dir).select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(own), " ").cast("binary")).alias("tokens"))


@catalog.add(
    f"""WITH w AS (SELECT doc_id, text, list_filter(string_split({COLLAPSED}, ' '), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN len(w) <= 60 THEN [text] ELSE list_transform(range(1, len(w) + 1, 45), lambda i: array_to_string(w[i:i + 59], ' ')) END AS c FROM w)
SELECT doc_id, (n - 1)::BIGINT AS chunk, md5(c[n]) AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS n FROM c)"""
)
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(fn.chunks(F.col("text"), 60)).alias("chunk", "text"))
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.col("text").cast("binary")).alias("text"))


QUALITY_CUES, FUNCTION_CUES = "(?i)\\b(licen[sc]ed?|rights)\\b", "(?i)\\b(token|mail[0-9]+)\\b"


@catalog.add(
    """WITH m AS (SELECT doc_id, text, regexp_matches(text, '(?i)\\b(licen[sc]ed?|rights)\\b') AS n, regexp_matches(text, '(?i)\\b(token|mail[0-9]+)\\b') AS f FROM documents)
SELECT doc_id, CASE WHEN n AND NOT f THEN 'NFR' WHEN f AND NOT n THEN 'FR' ELSE 'unknown' END AS kind,
  CASE WHEN n AND NOT f THEN lower(regexp_extract(text, '(?i)\\b(licen[sc]ed?|rights)\\b', 0)) WHEN f AND NOT n THEN lower(regexp_extract(text, '(?i)\\b(token|mail[0-9]+)\\b', 0)) ELSE '' END AS cue FROM m"""
)
def cue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, cue = fn.cue_type(F.col("text"), QUALITY_CUES, FUNCTION_CUES)
    return _docs(spark, sf_dir).select("doc_id", kind.alias("kind"), cue.alias("cue"))


RULES = {"LEGAL": "(?i)licen[sc]e|copyright|rights reserved", "CONTACT": "[0-9]+@|[+]1 [(]", "NETWORK": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "TABLE": "[|]", "SECRET": "token = "}


@catalog.add(
    "SELECT doc_id, concat_ws(';', "
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in RULES.items())
    + ") AS labels FROM documents"
)
def multi_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(fn.rule_labels(F.col("text"), RULES), ";").alias("labels"))


WEAK = ("clown", "trash", "worthless", "scum", "as")
_WEAK_SQL = "(?i)(^|[^a-z0-9])(worthless|clown|trash|scum|as)([^a-z0-9]|$)"


@catalog.add(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_WEAK_SQL}') THEN 'defect' ELSE 'ok' END AS label, lower(regexp_extract(text, '{_WEAK_SQL}', 2)) AS first_word FROM documents")
def weak_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, first = fn.weak_words(F.col("text"), WEAK)
    return _docs(spark, sf_dir).select("doc_id", label.alias("label"), first.alias("first_word"))


_LINES = "x AS (SELECT doc_id, n - 1 AS line_no, s[n] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"
_CLASS = """CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^(?i)(page )?[0-9]+( of [0-9]+)?$') THEN 'page_number' WHEN regexp_matches(trim(line), '^[0-9]+([.][0-9]+)*[.]? ') THEN 'numbered'
  WHEN regexp_matches(trim(line), '^[-*•] ') THEN 'bullet' WHEN length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')) > 3 AND regexp_replace(trim(line), '[^A-Za-z]', '', 'g') = upper(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')) THEN 'capitals' ELSE 'text' END"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@catalog.add(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, {_CLASS} AS kind FROM x")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", fn.line_class(F.col("line")).alias("kind"))


@catalog.add(
    f"""WITH {_LINES}, k AS (SELECT doc_id, trim(regexp_replace(line, {WS}, ' ', 'g')) AS line FROM x), s AS (SELECT doc_id, line, regexp_replace(lower(line), '[0-9]+', '#', 'g') AS shape FROM k WHERE length(line) BETWEEN 1 AND {requirements.FURNITURE_LENGTH}),
c AS (SELECT doc_id, shape, count(*) AS n FROM s GROUP BY 1, 2) SELECT doc_id, shape, n FROM c WHERE n >= {requirements.REPEATS} AND NOT regexp_matches(shape, '[.;:]$') AND NOT regexp_matches(shape, '\\b(shall|must|should|will|(is|are) required to)\\b')"""
)
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the lines that a document repeats as headers and footers do."""
    return requirements.furniture(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "shape", F.col("times").alias("n"))


MODALS, VERBS = ("the", "la", "der"), ("[a-z]+",)


@catalog.add(
    f"""WITH c AS (SELECT item_id, {COLLAPSED} AS t FROM benchmark), m AS (SELECT *, regexp_extract(t, '(?i)^(.*?)\\b(the|la|der)\\b', 1) AS subject, regexp_extract(t, '(?i)\\b(the|la|der)\\b', 1) AS modal FROM c),
a AS (SELECT *, substr(t, length(subject) + length(modal) + 1) AS rest FROM m),
b AS (SELECT *, regexp_extract(rest, '(?i)^(.*?)(\\s+and\\s+)[a-z]', 1) AS head, regexp_extract(rest, '(?i)^(.*?)(\\s+and\\s+)[a-z]', 2) AS joint FROM a),
p AS (SELECT item_id, 0 AS part, CASE WHEN modal = '' THEN t WHEN joint = '' THEN t ELSE subject || modal || head END AS s, 0 AS start, CASE WHEN joint = '' OR modal = '' THEN length(t) ELSE length(subject || modal || head) END AS stop,
  CASE WHEN modal = '' THEN 0.80 WHEN joint = '' THEN 0.96 ELSE 0.92 END AS confidence, modal FROM b
  UNION ALL SELECT item_id, 1, trim(trim(subject) || ' ' || modal || ' ' || substr(rest, length(head) + length(joint) + 1)), length(subject || modal || head || joint), length(t), 0.88, modal FROM b WHERE modal <> '' AND joint <> '')
SELECT item_id, part, md5(CASE WHEN modal = '' OR regexp_matches(trim(s), '[.!?]$') THEN trim(s) ELSE trim(s) || '.' END) AS text, start::INT AS "start", stop::INT AS "end", confidence::DOUBLE AS confidence FROM p"""
)
def rvu_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _items(spark, sf_dir).select("item_id", F.posexplode(fn.atomic_parts(F.col("text"), MODALS, VERBS)).alias("part", "p"))
    return parts.select("item_id", "part", F.md5(F.col("p.text").cast("binary")).alias("text"), "p.start", "p.end", "p.confidence")


BEHAVIOURS = {"NEGATIVE": ["thtion", "nicht"], "BOUNDARY": ["ingth", "than the"], "STATE": ["edth", "eau"]}


@catalog.add(
    "SELECT doc_id, CASE WHEN contains(lower(text), 'thtion') OR contains(lower(text), 'nicht') THEN 'NEGATIVE' WHEN contains(lower(text), 'ingth') OR contains(lower(text), 'than the') THEN 'BOUNDARY' WHEN contains(lower(text), 'edth') OR contains(lower(text), 'eau') THEN 'STATE' ELSE 'POSITIVE' END AS behaviour FROM documents"
)
def behavior_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fn.behaviour(F.col("text"), BEHAVIOURS).alias("behaviour"))


NUMBERS = (r"\b\d{3}-\d{4}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b\d{16}\b", r"\bversion \d+(?:\.\d+)?")


@catalog.add(
    "WITH c AS (SELECT doc_id, flatten(["
    + ", ".join(f"regexp_extract_all(text, '(?i){p}')" for p in NUMBERS)
    + "]) AS a FROM documents), u AS (SELECT doc_id, v, min(i) AS i FROM (SELECT doc_id, unnest(a) AS v, unnest(range(len(a))) AS i FROM c) GROUP BY 1, 2) SELECT doc_id, string_agg(v, ';' ORDER BY i) AS constraints FROM u GROUP BY 1"
)
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", fn.constraints(F.col("text"), NUMBERS).alias("found"))
    return found.where(F.size("found") > 0).select("doc_id", F.array_join("found", ";").alias("constraints"))


@catalog.add(
    """WITH q AS (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(lower(p), '[^a-z0-9]', '', 'g')), lambda p: length(p) >= 8) AS pieces FROM benchmark),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(k, pieces[1]) WHERE len(pieces) > 0 AND len(list_filter(pieces, lambda p: NOT contains(k, p))) = 0"""
)
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items all of whose lines are in a document: pairs meet over an item's longest line, then all lines are looked for."""
    items = _items(spark, sf_dir).withColumn("quote", F.regexp_replace("text", "\n", "..."))
    pieces = F.filter(F.transform(F.split("text", "\n"), fn.text_key), lambda p: F.length(p) >= 8)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]
    docs = _docs(spark, sf_dir)
    met = corpus.contained(items.select(F.col("item_id").alias("part_id"), longest.alias("part")), docs.select(F.col("doc_id").alias("text_id"), fn.text_key(F.col("text")).alias("text")))
    pairs = met.join(items.select(F.col("item_id").alias("part_id"), "quote"), "part_id").join(docs.select(F.col("doc_id").alias("text_id"), "text"), "text_id")
    return pairs.where(fn.grounded(F.col("quote"), F.col("text"))).select(F.col("part_id").alias("item_id"), F.col("text_id").alias("doc_id"))


@catalog.add(
    """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1) AS path FROM pages), s AS (SELECT page_id, string_split(path, '/') AS f FROM p)
SELECT page_id, CASE WHEN f[1] <> 'en' THEN 'unresolved' WHEN len(f) <= 2 THEN 'default' ELSE array_to_string(f[2:len(f) - 1], '.') END AS package FROM s"""
)
def package_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "^en/", "java/")
    return read(spark, sf_dir, "pages").select("page_id", fn.package_of_path(path).alias("package"))


# Letters whose second byte stands for nothing in the code page stay wrong.
_WRONG = "text"
for _letter in "ÁÍÏÐÝ":
    _WRONG = f"replace({_WRONG}, '{_letter}', 'Ã' || chr({_letter.encode()[1]}))"


@catalog.add(f"SELECT doc_id, md5({_WRONG}) AS text, regexp_matches(text, '[^\\x00-\\x7FÁÍÏÐÝ]') AS repaired FROM documents")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read with the wrong code page first, is itself again."""
    shown = {chr(b): c for c, b in encoding.HIGH.items() if b < 0xA0}
    wrong = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "".join(shown), "".join(shown.values()))
    return _docs(spark, sf_dir).select("doc_id", encoding.repair_mojibake(wrong).alias("r")).select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("text"), "r.repaired")

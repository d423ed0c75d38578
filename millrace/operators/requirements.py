"""Requirement texts: lines into blocks, blocks into candidate requirements.

Documents are exploded into lines; what a line is depends on itself, on how often its document repeats it and on the
line before, so blocks are one window per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import collapse, cue_type, sentences

# What marks modals, page furniture, numbered clauses, bullets, markers, notes and deleted clauses.
MODAL = r"(?i)\b(shall|must|should|will|(?:is|are) required to)\b"
LEADER = r"(?i)(\.\s?){4,}|…{2,}|…\s*\d+\s*$|_{6,}"
PAGE_NUMBER = r"^(?i)(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?$"
NUMBERED = r"^((?:\d+(?:\.\d+)+|\d+)[.)]?|\(?[a-z]\)|\([ivx]+\)|\([0-9]+\)|[A-Z]{1,5}[-_ ]?\d+(?:\.\d+)*[.:)])\s+(?=\S)"
BULLET = r"^[•·▪●\-*o]\s+(?=\S)"
MARKER = r"\[[A-Z]{2,6}\s?\d{1,6}(?:\s?,\s?[A-Z]{2,6}\s?\d{1,6})*\]"
HEADING_NUM = r"^\d+(\.\d+)*\.?\s+[A-Z]"
NOTE = r"^(?i)\s*(notes?\b|(?:for\s+)?examples?\s*[:.\-]|e\.g\.\s*[:,]|rationale\s*[:.\-]|comments?\s*[:.\-]|remarks?\s*[:.\-])"
DELETED = r"(?i)\*\*deleted\*\*|\(deleted\)|\[deleted\]|^\s*deleted\b|\bdeleted\.?\s*$"
# Cues of quality and of function, and the abbreviations that do not end a sentence.
NFR_CUES = r"(?i)\b(response time|within \d+(?:\.\d+)?\s?(?:ms|milliseconds?|seconds?|secs?|minutes?)|availability|reliab\w*|uptime|throughput|latency|encrypt\w*|authenticat\w*|confidential\w*|maintainab\w*|portab\w*|scalab\w*|usab\w*|accessib\w*|mean time between)\b"
FR_CUES = r"(?i)\b(?:shall|must|should|will)\s+(?:also\s+|then\s+)?(?:be able to\s+|allow\s+\w+\s+to\s+|enable\s+\w+\s+to\s+)?(?:display|calculate|generate|store|record|send|receive|accept|validate|print|search|create|delete|update|edit|add|remove|select|export|import|register|log\s?in|compute|transmit|report|notify)\b"
ABBREVIATION = r"(?i)(?:\b(?:e\.g|i\.e|etc|vs|no|fig|sec|inc|approx|cf|al)|\b[A-Za-z]|\d+(?:\.\d+)+)\.$"

REPEATS = 6
FURNITURE_LENGTH = 100


def whole_sentences(text: Column) -> Column:
    """Sentences of a text; what follows an abbreviation belongs to the sentence before."""

    def merged(out: Column, part: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(" "), part)))
        return F.when((F.size(out) > 0) & F.rtrim(F.try_element_at(out, F.lit(-1))).rlike(ABBREVIATION), joined).otherwise(F.array_append(out, part))

    return F.filter(F.transform(F.aggregate(sentences(text), F.array().cast("array<string>"), merged), F.trim), lambda s: s != "")


def is_heading(block: Column) -> Column:
    """Short and numbered, in capitals, or with a capital in front of each long word; no modal verb."""
    words = F.split(block, " ")
    n = F.size(words)
    modal = block.rlike(MODAL)
    sentence = (n > 14) | (block.rlike(r"[.:;,]$") & (n > 3))
    capitals = (F.upper(block) == block) & (F.lower(block) != block) & (n <= 10) & (F.length(block) > 3)
    titled = (n <= 6) & block.rlike(r"^\p{Lu}") & ~block.rlike(r"\.$") & F.forall(words, lambda w: (F.length(w) <= 3) | w.rlike(r"^\p{Lu}") | ~w.rlike(r"^\p{L}")) & ~modal
    return F.when(sentence, False).when(block.rlike(HEADING_NUM), ~modal).otherwise(capitals | titled)


def shaped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, number, line, shape): lines with white space of any kind as one blank, and in lower case with # for numbers."""
    raw = docs.select(id_col, F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\r"), F.lit("")), "\n")).alias("at", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", r"(?U)[\s\x1C-\x1F]+", " "), "^ | $", "")
    return raw.select(id_col, (F.col("at") + 1).alias("number"), line.alias("line")).withColumn("shape", F.regexp_replace(F.lower("line"), "[0-9]+", "#"))


def furniture(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, shape, times) of the lines that are headers or footers of their document, as ``lines`` says."""
    short = shaped(docs, id_col, text_col).where((F.length("line") > 0) & (F.length("line") <= FURNITURE_LENGTH))
    often = short.groupBy(id_col, "shape").agg(F.count("*").alias("times"))
    return often.where((F.col("times") >= REPEATS) & ~F.col("shape").rlike(r"[.;:]$") & ~F.col("shape").rlike(MODAL))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, number, line, kind): kind is blank, page_number, toc_line, header_footer or text.

    A line of at most FURNITURE_LENGTH characters that a document repeats REPEATS times, digits aside, is a header or
    footer, unless it ends as a sentence does or has a modal verb. Null texts have no lines.
    """
    own, often = shaped(docs, id_col, text_col), furniture(docs, id_col, text_col)
    line = F.col("line")
    kind = F.when(line == "", "blank").when(line.rlike(PAGE_NUMBER), "page_number").when(line.rlike(LEADER), "toc_line").when(F.col("times").isNotNull(), "header_footer").otherwise("text")
    return own.join(often, [id_col, "shape"], "left").select(id_col, "number", "line", kind.alias("kind"))


def blocks(classified: DataFrame, id_col: str) -> DataFrame:
    """(id_col, line_start, block): wrapped lines joined; a heading, a number, a bullet or a marker begins a block."""
    order = Window.partitionBy(id_col).orderBy("number")
    rows = classified.withColumn("heading", (F.col("kind") == "text") & is_heading(F.col("line")))
    starts = F.col("heading") | F.col("line").rlike(NUMBERED) | F.col("line").rlike(BULLET) | F.col("line").rlike(rf"^{MARKER}")
    after = F.coalesce(F.lag("kind").over(order) != "text", F.lit(True)) | F.coalesce(F.lag("heading").over(order), F.lit(False))
    numbered = rows.withColumn("new", ((F.col("kind") == "text") & (starts | after)).cast("int")).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = numbered.where("kind = 'text'").groupBy(id_col, "block").agg(F.min("number").alias("line_start"), F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l"))
    return own.select(id_col, "line_start", F.array_join(F.col("l.line"), " ").alias("block"))


def extract(found: DataFrame, id_col: str) -> DataFrame:
    """Candidates and dropped blocks: one row each, ``extraction_rule`` of the first, ``dropped`` of the second.

    A numbered or marked clause of at most three sentences and at least five words is one candidate, otherwise each
    sentence of four words with a modal verb is. Candidates of fewer than four words are dropped as too short.
    """
    block = F.col("block")
    number, bullet = F.regexp_extract(block, NUMBERED, 0), F.regexp_extract(block, BULLET, 0)
    rows = found.withColumn("prefix", F.when(number != "", number).otherwise(bullet))
    rows = rows.withColumn("body", F.trim(F.expr("substring(block, length(prefix) + 1)"))).withColumn("markers", F.regexp_extract_all(block, F.lit(MARKER), 0))
    rows = rows.withColumn("bare", F.regexp_replace("body", MARKER, "")).withColumn("sentences", whole_sentences(F.col("bare")))
    body, parts = F.col("body"), F.col("sentences")
    numbered = ((F.col("prefix") != "") & (bullet == "")) | (F.size("markers") > 0)
    clause = numbered & (F.size(parts) <= 3) & (F.size(F.split(body, r"\s+")) >= 5)
    modal = body.rlike(MODAL)
    spoken = body.rlike(r"^\p{Lu}") & (body.rlike(r"[.!?]$") | (F.size("markers") > 0))
    said = F.filter(parts, lambda s: s.rlike(MODAL) & (F.size(F.split(s, r"\s+")) >= 4) & ~s.rlike(NOTE))
    unit = lambda original, cleaned, rule: F.struct(original.alias("original_text"), cleaned.alias("cleaned"), F.lit(rule).alias("extraction_rule"))
    dropped = (
        F.when(block.rlike(DELETED), "deleted")
        .when(block.rlike(NOTE) | body.rlike(NOTE), "note_or_example")
        .when(is_heading(block) & ~block.rlike(MODAL), "heading")
        .when(clause & ~modal & ~spoken, "numbered_not_sentence_like")
        .when(~clause & (F.size(said) == 0), "no_requirement_cue")
    )
    units = F.when(clause & modal, F.array(unit(block, F.col("bare"), "numbered_clause_modal"))).when(clause, F.array(unit(block, F.col("bare"), "numbered_clause_no_modal"))).otherwise(F.transform(said, lambda s: unit(s, s, "modal_sentence")))
    none = F.array(F.struct(block.alias("original_text"), block.alias("cleaned"), F.lit(None).cast("string").alias("extraction_rule")))
    rows = rows.withColumn("dropped", dropped).select(id_col, "line_start", F.trim("prefix").alias("clause_label"), F.array_join(F.transform("markers", lambda m: F.btrim(m, F.lit("[]"))), ",").alias("source_marker"), "dropped", F.inline(F.when(F.col("dropped").isNull(), units).otherwise(none)))
    rows = rows.withColumn("cleaned_text", collapse(F.regexp_replace("cleaned", MARKER, ""))).withColumn("word_count", F.size(F.split("cleaned_text", " ")))
    short = F.col("dropped").isNull() & (F.col("word_count") < 4)
    kind, cue = cue_type(F.col("cleaned_text"), NFR_CUES, FR_CUES)
    return rows.select(
        id_col, "line_start", "clause_label", "source_marker", "original_text", "cleaned_text", "word_count", kind.alias("candidate_type"), cue.alias("type_cue"), "extraction_rule",
        F.when(F.col("word_count") > 120, "long_over_120_words").otherwise("").alias("length_flag"), F.when(short, "too_short").otherwise(F.col("dropped")).alias("dropped"),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All candidate requirements of all documents."""
    return extract(blocks(lines(docs, id_col, text_col), id_col), id_col).where("dropped is null").drop("dropped")

"""Sources: files in the formats that the analyses read, each as a typed frame."""

from __future__ import annotations

import csv as _csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.columns import checkpointed
from millrace.functions.encoding import decoded

# Elements whose content is no text, and elements that stand on lines of their own.
UNREAD = "script style head title noscript".split()
OWN_LINE = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre td th dt dd hr".split()
# Named characters of HTML that occur in prose; the ampersand is decoded last.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "euro": "\u20ac"}


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: str = "") -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped, ``missing`` reads as null."""
    reader = spark.read.option("header", True).option("nullValue", missing).option("mode", "PERMISSIVE")
    frame = (reader.schema(schema) if schema else reader).csv(path)
    return frame.toDF(*(c.lstrip("﻿") for c in frame.columns))


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV in which every value is a string as written; empty stays empty and is not missing."""
    frame = spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")
    return frame.toDF(*(c.lstrip("﻿") for c in frame.columns))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line, repaired) of text files in UTF-8, or cp1252 and Latin-1 line by line where that fails."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for number, raw in enumerate(content.splitlines()):
                    for codec in ("utf-8", "cp1252", "latin-1"):
                        try:
                            rows.append((name, number, raw.decode(codec), codec != "utf-8"))
                            break
                        except UnicodeDecodeError:
                            continue
                yield pd.DataFrame(rows, columns=["path", "line_no", "line", "repaired"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lines, "path string, line_no long, line string, repaired boolean")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, line) of text files: every line in raw bytes without its line feed. ``block`` is where the part of
    the file begins that a task reads, and lines of a part are in the order of ``place``; no task reads a whole file."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line")
    )


def mixed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with a header in UTF-8 with stray Windows-1252 bytes, all columns as texts, and ``encoding_repaired``.

    Lines are decoded by themselves, so a stray byte spoils nothing else. A line break inside quotes belongs to its value, so a
    record is the lines up to where the quotes are closed: quotes are counted by the part of the file that a task reads, the
    counts of the parts before are added, and each record is parsed from its own lines. All files have the header of the
    first one; a byte order mark is dropped. Empty records are left out; empty values and those that a record lacks are empty texts.
    """
    raw = raw_lines(spark, path)
    text = decoded(F.col("line"))
    lines = raw.select("file", "block", "place", text.alias("d")).select("file", "block", "place", "d.text", "d.repaired")
    lines = checkpointed(lines.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))))
    parts = lines.groupBy("file", "block").agg(F.sum("quotes").alias("own"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("own", "n")))
    so_far = Window.partitionBy("file", "block").orderBy("place")
    before = F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("own_before")
    placed = lines.join(parts, ["file", "block"]).withColumn("begins", (before % 2 == 0).cast("int")).withColumn("line_no", F.row_number().over(so_far) - 1 + F.col("n_before"))
    starts = placed.groupBy("file", "block").agg(F.sum("begins").alias("starts"))
    starts = starts.select("file", "block", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("starts_before"))
    numbered = placed.join(starts, ["file", "block"]).withColumn("record", F.sum("begins").over(so_far) + F.col("starts_before"))
    records = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.bool_or("repaired").alias("encoding_repaired"))
    whole = checkpointed(records.select("file", "record", F.regexp_replace(F.array_join(F.col("l.text"), "\n"), r"\r\z", "").alias("text"), "encoding_repaired"))
    options = {"escape": '"', "multiLine": "true", "emptyValue": "", "nullValue": "\0", "maxCharsPerColumn": "-1"}
    header = whole.where("record = 1").orderBy("file").select(F.regexp_replace("text", "^\ufeff", "").alias("text")).first()
    names = next(_csv.reader([header["text"]])) if header and header["text"] else []
    if not names:
        return spark.createDataFrame([], "encoding_repaired boolean")
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    values = whole.where("record > 1 and text != ''").select("encoding_repaired", F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("v"))
    return values.select(*(F.coalesce(F.col(f"v.c{k}"), F.lit("")).alias(name) for k, name in enumerate(names)), "encoding_repaired")


def partition_from_name(frame: DataFrame, pattern: str, name: str) -> DataFrame:
    """``frame`` with the part of its file names that ``pattern`` captures."""
    return frame.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def first_available(frames: Sequence[tuple[int, DataFrame]], key: Sequence[str]) -> DataFrame:
    """Rows of several sources, of each key those of the source with the smallest number."""
    all_ = None
    for number, frame in frames:
        part = frame.withColumn("source_rank", F.lit(number))
        all_ = part if all_ is None else all_.unionByName(part, allowMissingColumns=True)
    best = all_.groupBy(*key).agg(F.min("source_rank").alias("source_rank"))
    return all_.join(best, [*key, "source_rank"])


def json_records(spark: SparkSession, path: str, record: str, wrappers: Sequence[str]) -> DataFrame:
    """Records of JSON documents: a list, or an object that holds the list under one of ``wrappers``."""
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", ", ".join(f"{w} array<{record}>" for w in wrappers))
    listed = F.col("value").rlike(r"^\s*\[")
    found = F.when(listed, F.from_json("value", f"array<{record}>")).otherwise(F.coalesce(*(wrapped[w] for w in wrappers)))
    return whole.select(F.explode(found).alias("r")).select("r.*")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of JSON-lines logs up to the first broken line of each file (a half-written last line is usual)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    parsed = lines.withColumn("event", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = parsed.where(F.col("event").isNull() | F.col("event._broken").isNotNull()).groupBy("file").agg(F.min("place").alias("stop"))
    kept = parsed.join(bad, "file", "left").where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    return kept.select("file", "place", "event.*").drop("_broken")


def arff_payload(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, text, label) of comment lines ``% part, number, text,label`` in ARFF files."""
    line = r"^%\s*(\w+),\s*(\d+),\s*(.*),\s*([^,]*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(*(F.regexp_extract("value", line, i).alias(n) for i, n in ((1, "part"), (2, "number"), (3, "text"), (4, "label")))).withColumn("number", F.col("number").cast("int"))


def source_files(spark: SparkSession, path: str, suffix: str = ".java", skip: Sequence[str] = ("test", "target", "build", "generated", "node_modules")) -> DataFrame:
    """(path, text) of source files under ``path`` outside the skipped folders."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))


def surefire(spark: SparkSession, path: str) -> DataFrame:
    """Test results of Surefire reports: failure before error before skipped, times in milliseconds."""
    schema = "_classname string, _name string, _time double, failure string, error string, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\0").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "FAIL").when(F.col("error").isNotNull(), "ERROR").when(F.col("skipped").isNotNull(), "SKIPPED").otherwise("PASS")
    name = F.trim(F.regexp_replace("_name", r"[\[(].*$", ""))
    return cases.select(F.col("_classname").alias("class_name"), name.alias("method_name"), status.alias("status"), (F.col("_time") * 1000).alias("duration_ms"))


def _numbered(text: Column) -> Column:
    """Numeric character references decoded, each distinct one of a text once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"), 1))

    def decoded(out: Column, code: Column) -> Column:
        number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        wide = F.lpad(F.hex(number), 8, "0")
        letter = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(wide), "UTF-32")).otherwise("\ufffd")
        return F.replace(out, F.concat(F.lit("&#"), code, F.lit(";")), letter)

    return F.aggregate(found, text, decoded)


def html_text(html: Column) -> Column:
    """Readable text of HTML, by expressions alone: comments, scripts, styles and the head left out, a line for each
    block, entities decoded, white space collapsed and empty lines dropped. Null stays null."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    bare = F.regexp_replace(bare, rf"(?is)<({'|'.join(UNREAD)})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    lined = F.regexp_replace(bare, rf"(?i)</?(?:{'|'.join(OWN_LINE)})\b[^>]*>", "\n")
    plain = F.regexp_replace(lined, r"</?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    for name, letter in NAMED.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(letter))
    plain = F.replace(_numbered(plain), F.lit("&amp;"), F.lit("&"))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B\u00A0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def database(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database (or ``(query) name``) over JDBC; with a numeric ``column``, in ``parts`` ranges of it at once.

    Filters and columns that a query asks for are pushed down to the database. Without ``column``, one task reads all.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds").load().first()
    ranged = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if low is None:
        return ranged.load()
    return ranged.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


# Fields of evidence files, and what a missing field or null of the shared ones counts as, by kind.
EVIDENCE = "evidence_id string, title string, description string, execution_status string, source_tool string, source_version string, synthetic boolean"
MANUAL = "preconditions array<string>, inputs array<string>, steps array<string>, expected_result string, assertions array<string>"
PERFORMANCE = "metric string, measured_value double, threshold double, percentile double, load string, duration_seconds double, scope string, unit string, configuration map<string, string>"
KINDS = {"MANUAL_TEST": (MANUAL, "C3_MANUAL_CURATED", False), "PERFORMANCE_EVIDENCE": (PERFORMANCE, "C3_CONTROLLED_PERFORMANCE_FIXTURE", True)}


def evidence(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Evidence of one of ``KINDS`` from files that hold a JSON array each, in the columns that all kinds share.

    Fields of the other kind are null, lists and maps that are missing are empty. A record that lacks its id or title
    stays with a null there, for the contracts to find.
    """
    fields, tool, synthetic = KINDS[kind]
    raw = spark.read.schema(f"{EVIDENCE}, {fields}").option("multiLine", True).json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("source_path"))
    for name, kind_of in raw.dtypes:
        if kind_of.startswith("array"):
            raw = raw.withColumn(name, F.coalesce(name, F.array().cast(kind_of)))
        elif kind_of.startswith("map"):
            raw = raw.withColumn(name, F.coalesce(name, F.create_map().cast(kind_of)))
    known = {"description": "", "source_tool": tool, "source_version": "1.0", "synthetic": synthetic}
    raw = raw.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in known.items()})
    empty = spark.createDataFrame([], ", ".join([EVIDENCE, "source_path string", MANUAL, PERFORMANCE]))
    return empty.unionByName(raw, allowMissingColumns=True).withColumns({"evidence_type": F.lit(kind), "raw_reference": F.col("evidence_id")})

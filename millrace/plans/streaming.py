"""The events table as a log: once as a batch, once as a stream over its file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import shared_folder
from millrace.plans.registry import Catalog, read
from millrace.sources import readers
from millrace.streaming import monitor

catalog = Catalog()
TUMBLING = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@catalog.add(TUMBLING)
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.tumbling(read(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@catalog.add("SELECT w AS window_start, event_type, count(*) AS events FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w, event_type, ts FROM events) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.sliding(read(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@catalog.add(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, k"""
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.sessions(read(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "events")
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


@catalog.add("SELECT user_id AS run, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS verified, count(*) FILTER (WHERE event_type = 'view') AS rejected FROM events GROUP BY 1")
def stream_live_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals that a stream over the log leaves behind; equal to the batch result."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "click", "verified").when(F.col("event_type") == "view", "rejected").otherwise("other")
    totals = monitor.live_runs(_events_stream(spark, sf_dir).select(F.col("user_id").alias("run"), kind.alias("type")))
    monitor.drain(totals, f"{folder}/checkpoint", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"), "update")
    every = spark.read.parquet(folder + "/batch=*").withColumn("_b", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long"))
    return every.groupBy("run").agg(F.max_by(F.struct("events", "verified", "rejected"), "_b").alias("r")).select("run", "r.*")


_HTML = r"""regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g')"""
for _name in readers.UNREAD:
    _HTML = rf"""regexp_replace({_HTML}, '(?is)<{_name}\b[^>]*>.*?(?:</{_name}\s*>|\z)', '', 'g')"""
_HTML = rf"""regexp_replace(regexp_replace({_HTML}, '(?i)</?(?:{'|'.join(readers.OWN_LINE)})\b[^>]*>', chr(10), 'g'), '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"""
for _name, _letter in readers.NAMED.items():
    _HTML = f"replace({_HTML}, '&{_name};', chr({ord(_letter)}))"


@catalog.add(
    rf"""WITH t AS (SELECT page_id, html, replace({_HTML}, '&amp;', '&') AS t FROM pages)
SELECT page_id, CASE WHEN html IS NOT NULL THEN array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) END AS text FROM t"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every page."""
    return read(spark, sf_dir, "pages").select("page_id", readers.html_text(F.col("html")).alias("text"))


@catalog.add("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) AS n FROM events) WHERE n = 1")
def events_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user, type and day."""
    day = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    best = day.groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id"))
    return best.select("event_id", "user_id", "event_type")

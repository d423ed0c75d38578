"""Structured Streaming: link monitoring, live run metrics, and event-time aggregates with late data.

Every function takes and returns streaming (or batch) frames, or starts one query with ``availableNow``; state lives
in Spark's state store and in tables, never in the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark (times without a zone are read in the session's); a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of each window and key; in a stream, rows later than ``late`` behind the newest are dropped."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "events", "total")


def sliding(events: DataFrame, ts: str = "ts", width: str = "2 days", slide: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), by, "events")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each key: they end after ``gap`` without an event."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def first_within(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of ``key`` that arrive within the watermark."""
    if events.isStreaming:
        return _watermarked(events, ts, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def live_runs(log: DataFrame) -> DataFrame:
    """Running totals of each run in an append-only log (run, type)."""
    return log.groupBy("run").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "verified").alias("verified"), F.count_if(F.col("type") == "rejected").alias("rejected"))


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs ``write`` on every micro-batch of what is there, then stops; ``checkpoint`` keeps the place."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def collect_to(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Appends what the stream gives to Parquet under ``folder``, exactly once, and reads it back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)


def file_stream(spark: SparkSession, like: DataFrame, folder: str, files_at_once: int = 1) -> DataFrame:
    """The Parquet files under ``folder`` as a stream, some at a time in the order of their age."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def monitor(links: Callable[[], DataFrame], verify: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer that rechecks the links of changed artifacts (id, text_hash).

    Only verified links of a changed target whose hash differs are verified again, each once a batch; ``verify``
    returns (source_id, target_id, accepted), ``save`` gets (source_id, target_id, status, text_hash) and must be
    idempotent by batch number, as a batch may come twice.
    """

    def write(changes: DataFrame, batch: int) -> None:
        newest = changes.groupBy("id").agg(F.max_by("text_hash", "at").alias("new_hash"))
        due = links().where("status = 'verified'").join(newest, F.col("target_id") == F.col("id")).where(~F.col("text_hash").eqNullSafe(F.col("new_hash")))
        verdicts = verify(due.select("source_id", "target_id", "new_hash")).select("source_id", "target_id", "accepted")
        out = due.select("source_id", "target_id", "new_hash").join(verdicts, ["source_id", "target_id"])
        save(out.select("source_id", "target_id", F.when(F.col("accepted"), "verified").otherwise("decayed").alias("status"), F.col("new_hash").alias("text_hash")), batch)

    return write

"""Reactions to changes of a repository: links of what changed are verified again, what is new is linked, decay is announced.

Change messages come as a stream of JSON texts. Each micro-batch makes the next version of the link table from the one
before it, and one folder of events; both are named by the number of the batch, so a batch that comes twice, after a lost
driver for instance, writes the same again over the same names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.columns import checkpointed

# The shape of an id, how many a message may list, the names of its lists, and of the event.
ID, MOST_IDS = r"[^\s\x00-\x1f]{1,200}", 500
LISTS = {"changed": ("changed",), "added": ("added",), "requirements_added": ("requirementsAdded", "requirements_added")}
EVENT = "trace_decayed"
# Fixed value: the confidence from which an accepted link holds.
HOLDS = 0.5
LINK = "source_id string, target_id string, confidence double, status string, text_hash string, verified_at long, checked_at long"


def parse_changes(messages: DataFrame, value: str = "value") -> DataFrame:
    """``messages`` with project, changed, added and requirements_added (lists of distinct ids) and ``error``: why a message
    is not taken (its lists are empty then). Null and invalid JSON, other types, bad ids, long lists and empty changes are
    errors; unknown fields are ignored."""
    raw = F.col(value)
    kinds = F.try_parse_json(raw)
    object_ = F.startswith(F.schema_of_variant(kinds), F.lit("OBJECT"))
    errors = [F.when(raw.isNull() | kinds.isNull(), "not valid JSON"), F.when(~object_, "a change message must be a JSON object")]
    full = rf"^{ID}\z"

    def at(name: str):
        return F.try_variant_get(kinds, f"$.{name}", "variant")

    project = F.try_variant_get(kinds, "$.project", "string")
    said = F.schema_of_variant(at("project"))
    errors.append(F.when(said.isNotNull() & ~said.isin("VOID") & ((said != "STRING") | ~project.rlike(full)), "project must be a string"))
    lists = {}
    for name, keys in LISTS.items():
        found = F.coalesce(*(F.when(~F.is_variant_null(at(k)), at(k)) for k in keys))
        kind, ids = F.schema_of_variant(found), F.try_variant_get(found, "$", "array<string>")
        bad = found.isNotNull() & (~F.startswith(kind, F.lit("ARRAY")) | (F.size(F.try_variant_get(found, "$", "array<variant>")) > MOST_IDS))
        errors.append(F.when(bad, f"{keys[0]} must be a list of at most {MOST_IDS} ids"))
        sound = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(ids, lambda x: x.isNull() | ~x.rlike(full))
        errors.append(F.when(found.isNotNull() & ~F.coalesce(sound, F.lit(False)), f"{keys[0]} contains an invalid id"))
        lists[name] = F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))
    empty = sum((F.size(x) for x in lists.values()), F.lit(0)) == 0
    errors.append(F.when(empty, "the change lists no files and no requirements"))
    error = F.coalesce(*errors)
    none = F.array().cast("array<string>")
    return messages.select("*", F.when(error.isNull(), project).alias("project"), *(F.when(error.isNull(), x).otherwise(none).alias(n) for n, x in lists.items()), error.alias("error"))


@dataclass
class LinkStore:
    """Versions of the link table (LINK) and events under a folder that all executors share."""

    spark: SparkSession
    folder: str

    def _versions(self, part: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = (s.getPath() for s in files.listStatus(path))
        found = ((re.fullmatch(r"batch=(-?\d+)", p.getName()), p) for p in done)
        return sorted(int(m[1]) for m, p in found if m and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def before(self, batch: int) -> DataFrame:
        """The links as the last batch before ``batch`` left them."""
        known = [v for v in self._versions("links") if v < batch]
        return self.spark.read.schema(LINK).parquet(f"{self.folder}/links/batch={known[-1]}") if known else self.spark.createDataFrame([], LINK)

    def current(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, part: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/batch={batch}")

    def events(self) -> DataFrame:
        """(event, requirementId, codeEntityId, previousConfidence, newConfidence, at) of all batches, each once."""
        return self._all("events", "event string, requirementId string, codeEntityId string, previousConfidence double, newConfidence double, at long")

    def summaries(self) -> DataFrame:
        return self._all("summary", "batch long, rechecked long, decayed long, candidates long, linked long, errors long")

    def _all(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/batch={v}" for v in self._versions(part)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def rechecked(links: DataFrame, changed: DataFrame, texts: DataFrame, verify: Callable[[DataFrame], DataFrame], at: int) -> tuple[DataFrame, DataFrame]:
    """``links`` after those with a ``changed`` (id) target and another text_hash than in ``texts`` (source_id, target_id,
    text_hash) were verified again, and the rows (source_id, target_id, before, after, decayed) of those that were.

    ``verify`` gives (source_id, target_id, is_linked, confidence); a null in it is a malformed answer and changes nothing.
    A link that holds is fresh again, one that does not is decayed and keeps the hash that it held for.
    """
    key = ["source_id", "target_id"]
    mine = links.where("status = 'verified'").join(changed.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    due = mine.select(*key, "text_hash").join(texts.select(*key, F.col("text_hash").alias("now")), key).where(~F.col("text_hash").eqNullSafe(F.col("now")))
    answers = verify(due.select(*key)).select(*key, "is_linked", F.col("confidence").alias("after")).where("is_linked is not null and after is not null")
    judged = checkpointed(due.join(answers, key).select(*key, "now", "after", (~(F.col("is_linked") & (F.col("after") >= HOLDS))).alias("decayed")))
    joined = links.join(judged, key, "left")
    hit, holds = F.col("decayed").isNotNull(), ~F.col("decayed")
    out = joined.select(
        *key, F.coalesce("after", "confidence").alias("confidence"), F.when(hit, F.when(holds, "verified").otherwise("decayed")).otherwise(F.col("status")).alias("status"),
        F.when(hit & holds, F.col("now")).otherwise(F.col("text_hash")).alias("text_hash"), "verified_at", F.when(hit, F.lit(at)).otherwise(F.col("checked_at")).alias("checked_at"),
    )
    return out, judged.join(links.select(*key, F.col("confidence").alias("before")), key).select(*key, "before", "after", "decayed")


def new_candidates(links: DataFrame, added: DataFrame, requirements_added: DataFrame, sources: DataFrame, targets: DataFrame, shortlist: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs (source_id, target_id) to verify: a new requirement with any target, any requirement with a new target, as far as
    the ``shortlist`` of the requirement (query, target) over all targets has them and no link is known."""
    fresh, code = requirements_added.select(F.col("id").alias("source_id")).distinct(), added.select(F.col("id").alias("target_id")).distinct()
    asking = sources if not code.isEmpty() else sources.join(fresh.select(F.col("source_id").alias("id")), "id", "left_semi")
    near = shortlist(asking, targets).select(F.col("query").alias("source_id"), F.col("target").alias("target_id")).distinct()
    new = near.join(fresh, "source_id", "left_semi").unionByName(near.join(code, "target_id", "left_semi")).distinct()
    return new.join(links.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def handler(
    store: LinkStore, sources: Callable[[], DataFrame], targets: Callable[[], DataFrame], shortlist: Callable[[DataFrame, DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], value: str = "value"
) -> Callable[[DataFrame, int], None]:
    """A batch writer for a stream of change messages.

    ``sources`` and ``targets`` give the artifacts (id, text) as they are now. Links of changed targets are verified again, then
    candidates of new requirements and new targets are; what holds becomes a link. Every decay is an event. The batch
    number stands for the time, so that a repeated batch gives equal rows.
    """

    def write(messages: DataFrame, batch: int) -> None:
        parsed = checkpointed(parse_changes(messages.select(value), value))
        ids = {name: parsed.select(F.explode(name).alias("id")).distinct() for name in LISTS}
        links, own, code = store.before(batch), sources(), targets()
        stamped = lambda pairs: pairs.join(own.select(F.col("id").alias("source_id"), F.col("text").alias("_s")), "source_id").join(code.select(F.col("id").alias("target_id"), F.col("text").alias("_t")), "target_id").select("source_id", "target_id", F.sha2(F.concat_ws("\0", "_s", "_t"), 256).alias("text_hash"))
        after, judged = rechecked(links, ids["changed"], stamped(links.select("source_id", "target_id")), verify, batch)
        candidates = checkpointed(new_candidates(links, ids["added"], ids["requirements_added"], own, code, shortlist))
        accepted = verify(candidates).where(F.col("is_linked") & (F.col("confidence") >= HOLDS))
        found = checkpointed(accepted.select("source_id", "target_id", "confidence").join(stamped(candidates), ["source_id", "target_id"]))
        fresh = found.select("source_id", "target_id", "confidence", F.lit("verified").alias("status"), "text_hash", F.lit(batch).cast("long").alias("verified_at"), F.lit(batch).cast("long").alias("checked_at"))
        gone = judged.where("decayed").select(
            F.lit(EVENT).alias("event"), F.col("source_id").alias("requirementId"), F.col("target_id").alias("codeEntityId"), F.col("before").alias("previousConfidence"), F.col("after").alias("newConfidence"), F.lit(batch).cast("long").alias("at")
        )
        counts = judged.agg(F.count("*").alias("rechecked"), F.count_if("decayed").alias("decayed"))
        counts = counts.join(candidates.agg(F.count("*").alias("candidates"))).join(found.agg(F.count("*").alias("linked"))).join(parsed.agg(F.count_if(F.col("error").isNotNull()).alias("errors")))
        store.write("events", gone, batch)
        store.write("summary", counts.select(F.lit(batch).cast("long").alias("batch"), "*"), batch)
        # the links come last: with them the batch counts as done
        store.write("links", after.unionByName(fresh), batch)

    return write


class LinkMonitor(StatefulProcessor):
    """Keeps hash, confidence and status of one link, between the events of it.

    Events (source_id, target_id, kind, text_hash, confidence, at in milliseconds) are verdicts on the link or changes of its
    target's text. Out come ``recheck`` rows for changes of a verified link whose hash differs, ``trace_decayed`` rows for
    verdicts below HOLDS, and ``overdue`` rows for links that got no verdict within ``patience`` of a change.
    """

    SCHEMA = "source_id string, target_id string, kind string, previous double, confidence double, at long"

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "text_hash string, confidence double, status string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.link.get()
        held, confidence, status, due = tuple(state) if state is not None else (None, None, "unknown", None)
        out = []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.at, r.kind)):
            if r.kind == "verdict":
                if due is not None:
                    self.handle.deleteTimer(due)
                    due = None
                if r.confidence >= HOLDS:
                    held, status = r.text_hash, "verified"
                elif status == "verified":
                    out.append((*key, EVENT, confidence, r.confidence, r.at))
                    status = "decayed"
                confidence = float(r.confidence)
            elif status == "verified" and r.text_hash != held:
                out.append((*key, "recheck", confidence, None, r.at))
                if due is None:
                    due = int(r.at) + self.patience
                    self.handle.registerTimer(due)
        self.link.update((held, confidence, status, due))
        yield pd.DataFrame(out, columns=["source_id", "target_id", "kind", "previous", "confidence", "at"]).astype({c: object for c in ("source_id", "target_id", "kind")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, confidence, status, _ = tuple(self.link.get())
        self.link.update((held, confidence, status, None))
        yield pd.DataFrame({"source_id": [key[0]], "target_id": [key[1]], "kind": ["overdue"], "previous": [confidence], "confidence": [None], "at": [expiredTimerInfo.getExpiryTimeInMs()]}).astype({c: object for c in ("source_id", "target_id", "kind")})

    def close(self) -> None:
        pass


def watch_links(events: DataFrame, patience: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """The stream of what LinkMonitor says of ``events``; times are those of the events, and run as far as the newest less ``late``.

    State is kept by link in RocksDB, so ``spark.sql.streaming.stateStore.providerClass`` must name that store.
    """
    timed = events.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)
    return timed.groupBy("source_id", "target_id").transformWithStateInPandas(LinkMonitor(patience), LinkMonitor.SCHEMA, "append", "EventTime")

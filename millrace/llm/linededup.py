"""Line deduplication by a sharded minimal perfect hash.

1. Each document's distinct line keys become 128-bit hashes; Spark counts the documents of each hash.
2. At most ``HOT_SHARE`` keys can each be found in a ``HOT_SHARE``-th of all (document, key) pairs; these few, if
   any, go to all tasks, and everything below deals with keys of bounded frequency only.
3. The other hashes are dealt into shards of about ``SHARD_KEYS`` keys. A shard is a minimal perfect hash (levels of
   bit arrays: a key that is alone in its bit keeps it, the others go to the next level; a key's place is the rank
   of its bit) over an array of 32-bit fingerprints and an array of counts.
4. Documents probe: their hashes travel to the shards, which answer for the keys to drop; the lines themselves never
   move for that. A task holds one shard at a time.
5. Each document gets its answers and loses those lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import content_key, settle, small_batches

MIN_DOCUMENTS = 10
MIN_LENGTH = 1
SHARD_KEYS = 1 << 14
HOT_SHARE = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _hashed(text: bytes | None, min_length: int) -> list[bytes | None]:
    """A 16-byte hash for each line, None for keys that are too short."""
    keys = map(line_key, (text or b"").split(b"\n"))
    if min_length <= 1:
        return [xxhash.xxh3_128_digest(k) if k else None for k in keys]
    return [xxhash.xxh3_128_digest(k) if len(k.decode()) >= min_length else None for k in keys]


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _distinct(min_length: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [{h for h in _hashed(t, min_length) if h} for t in batch["text"]]
        a, b = _halves([h for s in sets for h in s])
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pd.DataFrame({"id": np.asarray(batch["id"], dtype=object)[at], "text_key": batch["text_key"].to_numpy()[at], "a": a, "b": b})


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (a ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) * _MIX + b
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash over the distinct keys (a, b): bit arrays as booleans."""
    levels = []
    while len(a):
        at = _slots(a, b, len(levels), len(a))
        alone = np.bincount(at, minlength=len(a)) == 1
        levels.append(alone)
        late = ~alone[at]
        a, b = a[late], b[late]
    return levels


def places(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each key in 0 .. n-1 (any place, or -1, for a key that was not built in)."""
    out, open_, before = np.full(len(a), -1), np.arange(len(a)), 0
    for level, bits in enumerate(levels):
        at = _slots(a[open_], b[open_], level, len(bits))
        here = bits[at]
        out[open_[here]] = before + (np.cumsum(bits) - 1)[at[here]]
        open_, before = open_[~here], before + int(bits.sum())
    return out


INDEX = "shard long, sizes array<int>, bits binary, prints binary, counts binary"


def _indexed(group: pd.DataFrame) -> pd.DataFrame:
    a, b = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
    levels = build(a, b)
    at = places(levels, a, b)
    prints, counts = np.zeros(len(a), dtype="<u4"), np.zeros(len(a), dtype="<u2")
    prints[at] = b & np.uint64(0xFFFFFFFF)
    counts[at] = np.minimum(group["n"], 0xFFFF)
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "sizes": [[len(x) for x in levels]], "bits": [b"".join(np.packbits(x).tobytes() for x in levels)], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})


def _opened(sizes: list[int], bits: bytes) -> list[np.ndarray]:
    levels, at = [], 0
    for n in sizes:
        width = -(-n // 8)
        levels.append(np.unpackbits(np.frombuffer(bits[at : at + width], dtype=np.uint8), count=n).astype(bool))
        at += width
    return levels


def _answers(min_documents: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, its arrays first: the probes whose key is in enough documents."""
    shard, levels, prints, counts = None, [], np.zeros(0), np.zeros(0)
    for batch in batches:
        numbers = batch["shard"].to_numpy()
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(batch)]):
            if numbers[s] != shard:
                shard, row = numbers[s], batch.iloc[s]
                levels = _opened(row["sizes"], row["bits"])
                prints, counts = np.frombuffer(row["prints"], dtype="<u4"), np.frombuffer(row["counts"], dtype="<u2")
                s += 1
            probes = batch.iloc[s:e]
            a, b = (probes[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
            at = places(levels, a, b)
            drop = (at >= 0) & (prints[at] == (b & np.uint64(0xFFFFFFFF))) & (counts[at] >= min_documents)
            lines = [x.tobytes() for x in np.stack([a[drop], b[drop]], axis=1)]
            yield pd.DataFrame({"id": np.asarray(probes["id"], dtype=object)[drop], "text_key": probes["text_key"].to_numpy()[drop], "line": pd.Series(lines, dtype=object)})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: ``id_col``, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of ``min_length``
    code points or more that are in ``min_documents`` documents or more lose all their lines. A null or empty text
    is one empty line and stays. Each row counts as a document, also one that repeats another. Null ids are ids
    like others. Other columns are ignored; an empty table gives an empty result. ``min_documents`` is at most
    65535, where counts saturate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), content_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    pairs = rows.mapInPandas(partial(_distinct, min_length), "id string, text_key long, a long, b long")
    counts = settle(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    heavy = counts.where(F.col("n") >= max(min_documents, -(-total // HOT_SHARE)))
    hot_rows = heavy.select("a", "b").collect()  # at most HOT_SHARE rows, whatever the input
    hot = frozenset(np.array([r.a, r.b], dtype="<i8").tobytes() for r in hot_rows)
    shards = max(1, -(-distinct // SHARD_KEYS))
    of = F.pmod(F.xxhash64("a", "b"), F.lit(shards))
    index = counts.withColumn("shard", of).groupBy("shard").applyInPandas(_indexed, INDEX)
    cold = pairs
    if hot_rows:
        cold = cold.join(F.broadcast(spark.createDataFrame(hot_rows, "a long, b long")), ["a", "b"], "left_anti")
    blank = {"kind": F.lit(0), "id": F.lit(None).cast("string"), "text_key": F.lit(0).cast("long"), "a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}
    asked = index.withColumns(blank).unionByName(cold.withColumns({"shard": of, "kind": F.lit(1)}), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = asked.repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    found = sorted_.mapInPandas(partial(_answers, min_documents), "id string, text_key long, line binary")
    drops = settle(found.groupBy("id", "text_key").agg(F.collect_set("line").alias("_drop")))

    @F.pandas_udf("kept_text string, n_lines long, n_dropped long")
    def without(texts: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = []
        for text, answer in zip(texts, answers):
            lines = (text or b"").split(b"\n")
            gone = hot if answer is None else hot.union(map(bytes, answer))
            stay = [r for r, h in zip(lines, _hashed(text, min_length)) if h not in gone] if gone else lines
            out.append((b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped"])

    keyed = docs.select(id_col, F.col(text_col).cast("binary").alias("_bytes"), content_key(F.col(text_col)).alias("_key"))
    joined = keyed.join(drops, (keyed["_key"] == drops["text_key"]) & keyed[id_col].cast("string").eqNullSafe(drops["id"]), "left")
    return joined.select(id_col, without("_bytes", "_drop").alias("_")).select(id_col, "_.n_lines", "_.n_dropped", "_.kept_text")

"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of length 0 to ``ORDER`` holds how often each byte followed each
context. A byte costs ``-log2 p`` bits, where ``p`` is its share in the longest context that has seen it, after
an escape from every longer context that has been seen but not with this byte (method C: a context with n
followers of u kinds gives c / (n + u) to a byte seen c times and u / (n + u) to the escape); below the empty
context every byte costs 8 bits. The language that needs the fewest bits for the whole text wins. The trees are
frozen: scoring a text never changes them.

Counts come from a bounded sample of the labelled rows (documents in hash order, ``train_bytes`` for each language and
``TRAIN_TOTAL`` for all of them) and are summed by Spark. The frozen trees, whose size that bound limits, are broadcast
to the tasks, which score whole texts in slices of bounded size. Languages share tables in groups of ``GROUP``, so the
tables grow with the sample and not with its grams times all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import settle, small_batches, whole

ORDER = 4
TRAIN_BYTES = 400_000
TRAIN_TOTAL = 4_000_000
GROUP = 8
SLICE = 1 << 19
BUCKETS = 64
BROADCAST_LANGUAGES = 10_000
UNKNOWN_BITS = 8.0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The context of ``order`` bytes and the byte itself, packed, for each position from ``order`` on."""
    n = max(0, len(data) - order)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(order + 1):
        packed = (packed << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return packed


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            parts: dict[int, list[np.ndarray]] = {k: [] for k in range(ORDER + 1)}
            for text in texts:
                data = np.frombuffer(text, dtype=np.uint8)
                for k in parts:
                    parts[k].append(_grams(data, k))
            for k, found in parts.items():
                grams, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "k": k, "gram": grams.astype(np.int64), "n": counts})


def sample(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, total: int = TRAIN_TOTAL) -> DataFrame:
    """Rows (lang, text as bytes) of ``labelled`` (id, text, lang), in hash order, up to ``train_bytes`` for each language.

    With more languages than ``total`` holds, each gets an equal share of it. A single text teaches by its first
    ``train_bytes`` at most, so a language has less than twice its bound, whatever the size of the corpus. Hash
    buckets, of which BUCKETS hold about the bound, are cut off where their running sum passes it, so no language is
    ever sorted or gathered in one task.
    """
    data = F.substring(F.col("text").cast("binary"), 1, train_bytes)
    rows = labelled.select("lang", data.alias("text"), F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("h"))
    sums = settle(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("all")))
    languages = sums.count()
    bound = min(train_bytes, total // max(1, languages))
    wide = F.least(F.lit(1 << 62), F.greatest(F.lit(1), F.lit(1 << 62) / F.greatest(F.lit(1), F.col("all")) * bound / BUCKETS)).cast("long")
    few = F.broadcast if languages <= BROADCAST_LANGUAGES else (lambda df: df)
    dealt = rows.join(few(sums), "lang").withColumn("bucket", (F.col("h") / wide).cast("long")).where(F.col("bucket") < 2 * BUCKETS)
    buckets = dealt.groupBy("lang", "bucket").agg(F.sum(F.octet_length("text")).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cuts = buckets.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < bound).groupBy("lang").agg(F.max("bucket").alias("cut"))
    return dealt.join(few(cuts), "lang").where("bucket <= cut").select("lang", "text")


class Trees:
    """Frozen context trees of some languages in arrays that are looked up by hash."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.langs = sorted(counts["lang"].unique())
        self.levels: list[dict[str, np.ndarray]] = []
        width = len(self.langs)
        for k in range(ORDER + 1):
            own = counts[counts["k"] == k]
            grams = np.unique(own["gram"].to_numpy(np.uint64))
            seen = np.zeros((len(grams), width))
            seen[np.searchsorted(grams, own["gram"].to_numpy(np.uint64)), np.searchsorted(self.langs, own["lang"])] = own["n"]
            context, start = np.unique(grams >> np.uint64(8), return_index=True)
            sizes = np.diff(np.r_[start, len(grams)])
            total, kinds = (np.add.reduceat(x, start, axis=0) if len(start) else np.zeros((0, width)) for x in (seen, (seen > 0).astype(float)))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                own_bits = np.repeat(np.log2(total + kinds), sizes, axis=0) - np.log2(seen)
            if k:
                shorter = self.levels[k - 1]["bits"][self._find(k - 1, grams & np.uint64((1 << 8 * k) - 1))]
            else:
                shorter = np.full((len(grams), width), UNKNOWN_BITS)
            bits = np.where(seen > 0, own_bits, np.repeat(escape, sizes, axis=0) + shorter)
            level = {"bits": bits, **self._hashed(grams)}
            self.levels.append(level)
            if k:
                escapes = np.zeros((len(self.levels[k - 1]["bits"]), width))
                escapes[self._find(k - 1, context)] = escape
                self.levels[k - 1]["escape"] = escapes.astype(np.float32)
            else:
                self.root_escape = escape[0] if len(escape) else np.zeros(width)
        for level in self.levels:
            level["bits"] = level["bits"].astype(np.float32)

    @staticmethod
    def _hashed(grams: np.ndarray) -> dict[str, np.ndarray]:
        """An open-addressing table of gram -> row."""
        log = max(8, int(np.ceil(np.log2(max(1, len(grams))))) + 2)
        slots = np.full(1 << log, -1, dtype=np.int32)
        rows = np.arange(len(grams), dtype=np.int32)
        at = ((grams * _SPREAD) >> np.uint64(64 - log)).astype(np.int64)
        while len(rows):
            free = slots[at] < 0
            slots[at[free]] = rows[free]
            late = slots[at] != rows
            rows, at = rows[late], (at[late] + 1) & ((1 << log) - 1)
        return {"slots": slots, "grams": grams, "log": np.array(log)}

    def _find(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Rows of the packed ``grams`` at order ``k``, -1 where unseen."""
        level = self.levels[k]
        slots, keys, log = level["slots"], level["grams"], int(level["log"])
        at = ((grams * _SPREAD) >> np.uint64(64 - log)).astype(np.int64)
        out = slots[at]
        if not len(keys):
            return out
        todo = np.flatnonzero((out >= 0) & (keys[out] != grams))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << log) - 1)
            out[todo] = slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (keys[out[todo]] != grams[todo])]
        return out

    def costs(self, data: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Bits of every byte (rows) under every language (columns), from contexts of at most ``reach`` bytes."""
        out = np.zeros((len(data), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(data))
        for k in range(ORDER, -1, -1):
            able = reach[open_] >= k
            here = open_[able]
            rows = self._find(k, _grams(data, k)[here - k])
            hit = rows >= 0
            out[here[hit]] += self.levels[k]["bits"][rows[hit]]
            missed = here[~hit]
            if k and len(missed):
                found = self._find(k - 1, _grams(data, k - 1)[missed - k])
                out[missed[found >= 0]] += self.levels[k - 1]["escape"][found[found >= 0]]
            open_ = np.concatenate([open_[~able], missed])
        out[open_] += (self.root_escape + UNKNOWN_BITS).astype(np.float32)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text under every language, by slices of at most SLICE bytes."""
        total = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > SLICE:
                data = np.frombuffer(text, dtype=np.uint8)
                for start in range(0, len(data), SLICE):
                    lead = min(ORDER, start)
                    part = data[start - lead : start + SLICE]
                    total[i] += self.costs(part, np.minimum(np.arange(len(part)), ORDER))[lead:].sum(axis=0, dtype=np.float64)
                continue
            if size + len(text) > SLICE:
                self._grouped(texts, group, total)
                group, size = [], 0
            if text:
                group.append(i)
                size += len(text)
        self._grouped(texts, group, total)
        return total

    def _grouped(self, texts: list[bytes], group: list[int], total: np.ndarray) -> None:
        """Several short texts at once; no context reaches into the text before."""
        if group:
            data = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
            starts = np.cumsum([0] + [len(texts[i]) for i in group[:-1]])
            reach = np.full(len(data), ORDER)
            for k in range(ORDER):
                reach[starts[starts + k < len(data)] + k] = np.minimum(reach[starts[starts + k < len(data)] + k], k)
            reach[starts] = 0
            total[group] = np.add.reduceat(self.costs(data, reach).astype(np.float64), starts, axis=0)


class Forest:
    """The trees of all languages, in groups of GROUP."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.langs = sorted(counts["lang"].unique())
        groups = [self.langs[k : k + GROUP] for k in range(0, len(self.langs), GROUP)]
        self.trees = [Trees(counts[counts["lang"].isin(g)]) for g in groups]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([t.lengths(texts) for t in self.trees], axis=1)


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> Forest:
    """Context trees of the languages in ``labelled`` (id, text, lang); rows with null text or lang teach nothing."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    texts = sample(rows, train_bytes)
    counts = texts.mapInPandas(_counted, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    found["lang"] = found["lang"].astype("category")
    return Forest(found)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _language(model: Broadcast, name: str) -> Column:
    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def language(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        forest = model.value
        names = np.array([*forest.langs, "und"], dtype=object)
        known = letters.to_numpy(bool) & (len(forest.langs) > 0)
        sizes = np.array([len(t) if k else 0 for t, k in zip(texts, known)])
        best, score, rate = np.full(len(texts), len(forest.langs)), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if known.any():
            bits = forest.lengths([t if k else b"" for t, k in zip(texts, known)])[known]
            best[known] = bits.argmin(axis=1)
            least = bits.min(axis=1)
            score[known] = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            rate[known] = least / sizes[known]
        return pd.DataFrame({"lang_pred": names[best], "score": score, "bits_per_byte": rate})

    return language(F.col(name).cast("binary"), has_letter(F.col(name))).alias("language")


def predict(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Structs ``doc`` (all columns of ``docs``) and ``language`` (lang_pred, score, bits_per_byte) from every whole text.

    ``lang_pred`` is the language with the shortest code (the first by name on a tie), ``score`` its posterior
    probability under equal priors. A null text or one without a letter is ``und`` with score 0 and null bits per
    byte, as is every text if nothing was learned. Repeated rows get equal results. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.select(whole(docs), F.col(text_col).alias("text")).select("doc", _language(model, "text"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


MAX_BITS_PER_BYTE = 12.0


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents in a language that the labelled rows teach; columns as in ``docs``.

    Goes: a document without a letter, and one that the best language's trees cannot compress to
    ``MAX_BITS_PER_BYTE`` (text of a learned language takes 2 to 4 bits a byte, and up to 9 if short or full of
    digits and capitals; bytes that no language has seen take about 20). All other documents stay, also those of which ``lang`` is null.
    """
    forest = train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    known = (F.col("language.lang_pred") != "und") & (F.col("language.bits_per_byte") <= MAX_BITS_PER_BYTE)
    return predict(docs, forest, text_col).where(known).select("doc.*")

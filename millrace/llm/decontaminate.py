"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit check.

A document holds a benchmark item if some run of its words is within ``floor(0.2 * L)`` word edits of the item's
L words (similarity 0.8 or more). Words are compared without case and ASCII punctuation.

* Windows. Every window of an item's size is looked at. One that has too few word trigrams of the items of that size
  cannot be within the allowed edits of any of them (each edit breaks three trigrams at most), whichever it is, and
  is passed over; so nothing is lost here.
* Embedding. The CGK walk reads a window's words through ``3 L`` steps and goes on to the next word, or stays,
  by a random bit for the step and the word. Windows within few edits come out within few differing steps, as the
  walks of both sides fall into step again after an edit.
* Hashing. Each table samples ``SAMPLED`` steps of one of ``WALKS`` walks; the words seen there are the key.
* Rest. Edits put the walks of long items out of step, so tables alone lose edited copies, the more the longer the
  item is. Where an item's own trigrams lie close enough together for a run within the allowed edits, the pair is
  checked as well, met in a table or not. So every such run is found, at any length.
* Check. Each pair of window or stretch and item is decided by the exact edit distance of the item to the best run of
  words there.

The items are indexed in blocks of at most ``BLOCK_WORDS`` words, whose size bounds what tasks receive; a
benchmark of more words takes more passes over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import content_key, settle, small_batches, whole

SIMILARITY = 0.8
GRAM = 3
WALKS = 4
TABLES = 10
SAMPLED = 4
BLOCK_WORDS = 200_000
WINDOWS_AT_ONCE = 1 << 13
MARK_BITS = 20
_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> list[bytes]:
    """The words that are compared."""
    return (text or "").lower().encode().translate(_FOLD).split()


def allowed(length: int) -> int:
    return int((1 - SIMILARITY) * length + 1e-9)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Index:
    """Items by length: trigram filter, CGK tables and the words themselves."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.words: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            if found := fold(text):
                self.items.append((item_id, np.array([self.words.setdefault(w, len(self.words) + 1) for w in found], dtype=np.int64)))
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for at, (_, ids) in enumerate(self.items):
            self.by_length[len(ids)].append(at)
        of_length = {n: np.unique(np.concatenate([self._packed(self.items[m][1], self.need(n)[0]) for m in members])) for n, members in self.by_length.items()}
        self.grams = {g: np.unique(np.concatenate([x for n, x in of_length.items() if self.need(n)[0] == g])) for g in {self.need(n)[0] for n in of_length}}
        self.held = {n: np.isin(self.grams[self.need(n)[0]], x) for n, x in of_length.items()}
        self.marks = {g: np.zeros(1 << MARK_BITS, dtype=bool) for g in self.grams}
        for g, found in self.grams.items():
            self.marks[g][((found.astype(np.uint64) * _MIX) >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
        self.tables = {n: self._hashed(n, members) for n, members in self.by_length.items()}
        self.postings = {n: self._posted(n, members) for n, members in self.by_length.items()}

    @staticmethod
    def _packed(ids: np.ndarray, g: int) -> np.ndarray:
        """Runs of g words as numbers, 0 where a word is unknown."""
        n = len(ids) - g + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        packed, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(g):
            packed = (packed << 20) | ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, packed, 0)

    @staticmethod
    def need(length: int) -> tuple[int, int]:
        """(g, t): a window within the allowed edits shares at least t runs of g words with the item."""
        k = allowed(length)
        for g in range(GRAM, 0, -1):
            if (t := length - g + 1 - k * g) >= 1:
                return g, t
        return 1, 1

    def _keys(self, length: int, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """LSH keys (windows x tables) of the windows of ``sizes`` words, ``length`` at most, at ``starts``."""
        rng = np.random.default_rng(length)
        steps = 2 * length
        out = np.zeros((WALKS * TABLES, len(starts)), dtype=np.uint64)
        for walk in range(WALKS):
            chosen: dict[int, list[int]] = defaultdict(list)
            for t in range(TABLES):
                for s in rng.choice(steps, min(SAMPLED, steps), replace=False):
                    chosen[int(s)].append(walk * TABLES + t)
            salt = rng.integers(1, 1 << 62, size=steps, dtype=np.uint64)
            offset = np.zeros(len(starts), dtype=np.int64)
            for step in range(max(chosen) + 1):
                word = np.where(offset < sizes, ids[np.minimum(starts + offset, len(ids) - 1)], -1).astype(np.uint64)
                mixed = _scramble(((word + np.uint64(2)) * _MIX) ^ salt[step])
                for row in chosen.get(step, ()):
                    out[row] = _scramble(out[row] * _MIX + mixed)
                offset += (mixed >> np.uint64(33)).astype(np.int64) & 1
        return _scramble(out.T + np.arange(WALKS * TABLES, dtype=np.uint64) * _MIX)

    def _hashed(self, length: int, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All (table, key) of the items of one length, sorted, and the items they belong to."""
        ids = np.concatenate([self.items[m][1] for m in members])
        keys = self._keys(length, ids, np.arange(len(members)) * length, np.full(len(members), length)).ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(np.array(members), WALKS * TABLES)[order]

    def _posted(self, length: int, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where the items of each run of words begin among the owners, and the owners."""
        g = self.need(length)[0]
        runs = [np.unique(self._packed(self.items[m][1], g)) for m in members]
        which = np.searchsorted(self.grams[g], np.concatenate(runs))
        order = np.argsort(which, kind="stable")
        owners = np.repeat(np.array(members), [len(r) for r in runs])[order]
        return np.searchsorted(which[order], np.arange(len(self.grams[g]) + 1)), owners

    def _stretches(self, length: int, at: np.ndarray, which: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, low, high, item): words that hold all runs within the allowed edits of an item, not clipped to the document.

        ``at`` are the positions of the shared runs ``which``. A run of words within k edits has at most length + k
        words and t of the item's own runs of g words.
        """
        g, t = self.need(length)
        wide = length + allowed(length)
        begins, owners = self.postings[length]
        near = np.zeros(len(at) + 1, dtype=np.int64)
        i = np.flatnonzero(at[t - 1 :] - at[: max(0, len(at) - t + 1)] <= wide - g)
        np.add.at(near, i, 1)
        np.add.at(near, i + t, -1)
        some = np.cumsum(near)[:-1] > 0
        at, which = at[some], which[some]
        counts = begins[which + 1] - begins[which]
        item = owners[np.repeat(begins[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        at = np.repeat(at, counts)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        doc = np.searchsorted(first, at, side="right")
        a, b = slice(0, max(0, len(at) - t + 1)), slice(t - 1, None)
        found = np.flatnonzero((item[a] == item[b]) & (doc[a] == doc[b]) & (at[b] - at[a] <= wide - g))
        low, high, of, where = at[found + t - 1] + g - wide, at[found] + wide, item[found], doc[found]
        if not len(found):
            return
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (where[1:] != where[:-1]) | (low[1:] > high[:-1])])
        for s, e in zip(new, np.r_[new[1:], len(of)] - 1):
            yield int(where[s]) - 1, int(low[s]), int(high[e]), int(of[s])

    def _shared(self, ids: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a run of g words of the benchmark starts, and which run it is."""
        packed = self._packed(ids, g)
        maybe = np.flatnonzero(self.marks[g][((packed.astype(np.uint64) * _MIX) >> np.uint64(64 - MARK_BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.grams[g], packed[maybe]), len(self.grams[g]) - 1)
        true = self.grams[g][which] == packed[maybe]
        return maybe[true], which[true]

    def _windows(self, length: int, at: np.ndarray) -> np.ndarray:
        """Starts of the windows with enough shared runs, which start at the positions ``at``."""
        g, t = self.need(length)
        if len(at) < t:
            return at[:0]
        reach = length + allowed(length) - g  # a run of words within k edits has up to length + k words
        a, b = at[: len(at) - t + 1], at[t - 1 :]
        near = b - a <= reach
        low, high = np.maximum(0, b[near] - reach), a[near]
        sizes = high - low + 1
        return np.unique(np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))

    def find(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, low, high, item): words to check for an item, from tables and then from its own runs; ``ids`` holds the words of several documents, ``first`` where each starts."""
        shared = {g: self._shared(ids, g) for g in self.grams}
        ends = np.r_[first[1:], len(ids)]
        for length, (keys, owners) in self.tables.items():
            at, which = shared[self.need(length)[0]]
            own = self.held[length][which]
            at, which = at[own], which[own]
            starts = self._windows(length, at)
            if not len(starts):
                continue
            k, rest = allowed(length), (at, which)
            sizes = np.minimum(length, ends[np.searchsorted(first, starts, side="right") - 1] - starts)
            wide = sizes >= length - allowed(length)
            starts, sizes = starts[wide], sizes[wide]
            for at in range(0, len(starts), WINDOWS_AT_ONCE):
                some = starts[at : at + WINDOWS_AT_ONCE]
                found = self._keys(length, ids, some, sizes[at : at + WINDOWS_AT_ONCE]).ravel()
                low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                for r in np.flatnonzero(high > low):
                    for owner in owners[low[r] : high[r]]:
                        start = int(some[r // (WALKS * TABLES)])
                        yield int(np.searchsorted(first, start, side="right")) - 1, start - k, start + length + k, int(owner)
            yield from self._stretches(length, *rest, first)


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edits, end): the fewest edits from ``item`` to any run of ``words``, and the first place where it ends."""
    above = np.arange(len(item) + 1)
    steps = np.arange(len(item) + 1)
    best, end = len(item), 0
    for at, word in enumerate(words):
        now = np.empty_like(above)
        now[0] = 0
        now[1:] = np.minimum(above[:-1] + (item != word), above[1:] + 1)
        above = np.minimum.accumulate(now - steps) + steps
        if above[-1] < best:
            best, end = int(above[-1]), at + 1
    return best, end


def _matches(index: Index, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lists = [[index.words.get(w, 0) for w in fold(t)] for t in batch["text"]]
        sizes = np.array([len(x) for x in lists])
        starts = np.cumsum(sizes) - sizes
        full = np.flatnonzero(sizes)
        ids = np.array([w for x in lists for w in x], dtype=np.int64)
        rows: dict[tuple[int, int], tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for place, low, high, owner in index.find(ids, starts[full]) if len(ids) else ():
            if (low, high, owner) in done:
                continue
            done.add((low, high, owner))
            item_id, item = index.items[owner]
            k = allowed(len(item))
            doc = int(full[place])
            low, high = max(int(starts[doc]), low), min(int(starts[doc] + sizes[doc]), high)
            if (doc, owner) in rows and rows[doc, owner][0] == 0:
                continue
            edits, end = best_run(item, ids[low:high])
            if edits <= k and edits < rows.get((doc, owner), (k + 1, 0))[0]:
                rows[doc, owner] = (edits, low - int(starts[doc]) + end)
        found = sorted(rows.items())
        yield pd.DataFrame(
            {
                "id": pd.Series([batch["id"].iloc[d] for (d, _), _ in found], dtype=object),
                "text_key": [batch["text_key"].iloc[d] for (d, _), _ in found],
                "item_id": [index.items[o][0] for (_, o), _ in found],
                "item_words": [len(index.items[o][1]) for (_, o), _ in found],
                "edits": [e for _, (e, _) in found],
                "end_word": [p for _, (_, p) in found],
            }
        )


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over the benchmark, each of about BLOCK_WORDS words; items without a word match nothing."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col)).distinct()
    held, words = [], 0
    for item_id, text in items.orderBy(id_col, text_col).toLocalIterator():
        held.append((item_id, text))
        words += len(fold(text))
        if words >= BLOCK_WORDS:
            yield Index(held)
            held, words = [], 0
    if held:
        yield Index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``id_col``, ``text_key``, ``item_id``, ``item_words``, ``edits``, ``end_word``.

    ``edits`` is the smallest distance found, ``end_word`` where that run of words ends. Null and empty texts hold
    nothing, nor does an empty benchmark give a row. Rows that repeat a document repeat its result. Other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("string").alias("id"), content_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    schema = "id string, text_key long, item_id long, item_words int, edits int, end_word int"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark, item_col, item_text):
        found = found.unionByName(rows.mapInPandas(partial(_matches, index), schema))
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "text_key", "item_id", "item_words", "edits", "end_word")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; columns as in ``docs``, whatever their names.

    Null and empty texts hold nothing and stay, as do repeated rows; an empty benchmark removes nothing.
    """
    held = settle(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).distinct())
    keyed = docs.select(whole(docs), F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("text_key"))
    return keyed.join(held, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("doc.*")

"""Spelling variants grouped through a trie of letter-group frequencies.

A word's path in the trie is its counts of GROUPS groups of letters, one level a group. One edit moves at most one unit
into the counts (a surplus) and one out of them (a deficit), so two words within one edit lie under paths that differ
by a budget of one surplus and one deficit; the words of such leaves are verified letter by letter.

Spark deals out the upper levels: every word is stored under its own upper node, and asks in each upper node before
its own that the budget reaches, with what is left of the budget. The number of upper levels is the fewest that leave
no node more than NODE words. A task holds one node at a time, builds the lower levels of stored and of asking words,
and searches both tries together, depth first, a block of node pairs at a time. Every pair of words is met once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_batches, partitions, settle

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
NOISE = 31
NODE = 12_000
PAIRS = 400_000
FLUSH = 300_000
# Letters of one group stand together; all other characters are dealt over two more groups. The most frequent letters of
# European texts have a group of their own.
LETTERS = ("e", "t", "a", "o", "i", "n", "s", "h", "r", "d", "l", "u", "cwpgkqz", "mfybvjx")
GROUPS = len(LETTERS) + 2
_GROUP = {c: g for g, own in enumerate(LETTERS) for c in own}
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def lower(word: str) -> str:
    """``word`` with A-Z, and nothing else, in lower case."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def noisy(doc: str, run: str) -> str:
    """``run`` as the document spells it: one in NOISE loses a code point, chosen by the checksum of id and run."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % NOISE or not run:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of at least LEAST_LENGTH code points with their number, summed up over many documents."""
    # A maximal run: the class is greedy, and a run that is too short to match anywhere has no longer part.
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
    sums: Counter[str] = Counter()
    for batch in batches:
        for doc, text in zip(batch["doc"], batch["text"]):
            own: Counter[str] = Counter()
            for run, n in Counter(runs.findall((text or b"").decode(errors="replace"))).items():
                own[lower(run)] += n
            for run, n in own.items():
                word = noisy(doc, run)
                if len(word) >= LEAST_LENGTH:
                    sums[word] += n
        if len(sums) > FLUSH:
            yield pd.DataFrame({"word": pd.Series(list(sums), dtype=object), "n": list(sums.values())})
            sums.clear()
    yield pd.DataFrame({"word": pd.Series(list(sums), dtype=object), "n": list(sums.values())})


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of the documents' texts and how often they occur, with the noise of ``noisy``.

    Null and empty texts have no words, a null id counts as empty in the checksum, repeated rows count again. Other
    columns are ignored, whatever their names. An empty table has no words.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    with arrow_batches(docs.sparkSession, 1000):
        counted = texts.mapInPandas(_counted, "word string, n long")
        return settle(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def path_of(word: str) -> list[int]:
    counts = [0] * GROUPS
    for c in word:
        counts[_GROUP.get(c, GROUPS - 2 + (ord(c) & 1))] += 1
    return counts


@F.pandas_udf(T.BinaryType())
def _paths(words: pd.Series) -> pd.Series:
    """Paths as GROUPS whole numbers of four bytes each."""
    return pd.Series([np.array(path_of(w), dtype="<u4").tobytes() for w in words], dtype=object)


def _matrix(paths: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(paths), dtype="<u4").astype(np.int64).reshape(len(paths), GROUPS)


# A node's number is the sum of its counts times these, so that a step away it differs by their difference.
_WEIGHTS = np.random.default_rng(911).integers(1, 1 << 63, size=GROUPS, dtype=np.uint64)


def reached(paths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each way to spend the budget by which a node can come before a path, its surplus and deficit: the rows of ``paths``
    (n, levels) that can go this way, the numbers of the nodes they reach, and what they have spent."""
    numbers = paths.astype(np.uint64) @ _WEIGHTS[: paths.shape[1]]
    for down in range(paths.shape[1]):
        rows = np.flatnonzero(paths[:, down] > 0)
        # the first count that differs is the smaller one: what is added comes after what is taken away
        for up in (None, *range(down + 1, paths.shape[1])):
            more = np.uint64(0) if up is None else _WEIGHTS[up]
            yield rows, numbers[rows] + more - _WEIGHTS[down], 1, int(up is not None)


def _dealt(levels: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word under its own upper node and, as one that asks, under the nodes before it that its budget reaches.

    ``spent`` is -1 for a stored word, else the surplus that is spent, and twice the deficit.
    """
    for batch in batches:
        upper = _matrix(batch["path"])[:, :levels]
        yield batch.assign(node=(upper.astype(np.uint64) @ _WEIGHTS[:levels]).view(np.int64), spent=-1)[DEALT]
        for rows, nodes, surplus, deficit in reached(upper):
            if len(rows):
                yield batch.iloc[rows].assign(node=nodes.view(np.int64), spent=surplus + 2 * deficit)[DEALT]


DEALT = ["node", "word", "n", "path", "spent"]


class _Trie:
    """Paths as levels of sorted distinct prefixes; ``first``/``last`` are the children of a node, at the end its words."""

    def __init__(self, paths: np.ndarray) -> None:
        self.order = np.lexsort(paths.T[::-1]) if paths.shape[1] else np.arange(len(paths))
        rows, (n, depth) = paths[self.order], paths.shape
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        starts = [np.flatnonzero(new)]
        for level in range(depth):
            new = new | np.r_[True, rows[1:, level] != rows[:-1, level]]
            starts.append(np.flatnonzero(new))
        starts.append(np.arange(n))
        self.count = [rows[starts[level + 1], level] for level in range(depth)]
        self.first = [np.searchsorted(starts[i + 1], starts[i]) for i in range(depth + 1)]
        self.last = [np.r_[f[1:], len(starts[i + 1])] for i, f in enumerate(self.first)]


def near_paths(a: _Trie, b: _Trie | None, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of words whose paths differ by at most so much surplus and deficit of ``b``; i < j if ``b`` is None."""
    other, depth = a if b is None else b, len(a.count)
    zero = np.zeros(1, dtype=np.int64)
    stack = [(0, zero, zero, zero, zero)]
    while stack:
        level, i, j, up, down = stack.pop()
        if len(i) > 1 and level <= depth:
            sizes = (a.last[level][i] - a.first[level][i]) * (other.last[level][j] - other.first[level][j])
            if sizes.sum() > PAIRS:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:], up[half:], down[half:]), (level, i[:half], j[:half], up[:half], down[:half])]
                continue
        wide = other.last[level][j] - other.first[level][j]
        sizes = (a.last[level][i] - a.first[level][i]) * wide
        if level == depth and len(i) == 1 and sizes[0] > PAIRS:
            yield from _large_leaves(a, other, b is None, level, int(i[0]), int(j[0]))
            continue
        of = np.repeat(np.arange(len(i)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x, y = a.first[level][i][of] + at // wide[of], other.first[level][j][of] + at % wide[of]
        if level == depth:
            keep = x < y if b is None else slice(None)
            yield a.order[x[keep]], other.order[y[keep]]
            continue
        more = other.count[level][y] - a.count[level][x]
        up, down = up[of] + np.maximum(more, 0), down[of] + np.maximum(-more, 0)
        keep = (up <= surplus) & (down <= deficit)
        if b is None:
            keep &= x <= y
        stack.append((level + 1, x[keep], y[keep], up[keep], down[keep]))


def _large_leaves(a: _Trie, b: _Trie, same: bool, level: int, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word pairs of two large leaves, some rows at a time."""
    ys = np.arange(b.first[level][j], b.last[level][j])
    step = max(1, PAIRS // len(ys))
    for at in range(a.first[level][i], a.last[level][i], step):
        xs = np.arange(at, min(at + step, a.last[level][i]))
        x, y = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
        keep = x < y if same else slice(None)
        yield a.order[x[keep]], b.order[y[keep]]


class Letters:
    """Words as one array of code points."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32) if words else np.zeros(0, dtype=np.uint32)

    def one_edit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i and j, which differ, are one insertion, deletion or replacement apart: what their ends share
        leaves at most one letter of the longer word."""
        short, long = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        out = (short == 0) & (long == 1)
        at = np.flatnonzero((long - short <= 1) & (short > 0))
        head, tail = (self.flat[self.start[k][at]] for k in (i, j)), (self.flat[self.start[k][at] + self.size[k][at] - 1] for k in (i, j))
        at = at[np.equal(*head) | np.equal(*tail)]
        need = long[at] - 1
        shared = self._common(i[at], j[at], np.minimum(short[at], need), 1)
        shared += self._common(i[at], j[at], np.minimum(short[at], need - shared), -1)
        out[at] = shared >= need
        return out

    def _common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many letters, up to ``most``, the words share from the start (or, for -1, from the end)."""
        a = self.start[i] if way > 0 else self.start[i] + self.size[i] - 1
        b = self.start[j] if way > 0 else self.start[j] + self.size[j] - 1
        shared, on = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        while len(on):
            on = on[shared[on] < most[on]]
            on = on[self.flat[a[on] + way * shared[on]] == self.flat[b[on] + way * shared[on]]]
            shared[on] += 1
        return shared


def _near(levels: int, node: pd.DataFrame) -> pd.DataFrame:
    """(word, k, n, form): of each word that the node found near ones for, how many, and the most frequent of them."""
    node = node.sort_values("spent", kind="stable")
    spent = node["spent"].to_numpy()
    words, counts = node["word"].tolist(), node["n"].to_numpy(np.int64)
    paths = _matrix(node["path"])[:, levels:]
    letters, stored = Letters(words), int((spent < 0).sum())
    trie, left, right = _Trie(paths[:stored]), [], []
    for of in np.unique(spent) if stored else ():
        own = np.flatnonzero(spent == of)
        pairs = near_paths(trie, None, 1, 1) if of < 0 else near_paths(trie, _Trie(paths[own]), 1 - int(of & 1), 1 - int(of >> 1))
        for i, j in pairs:
            j = own[j]
            found = letters.one_edit(i, j)
            left.append(i[found])
            right.append(j[found])
    x, y = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in (left, right))
    x, y = np.r_[x, y], np.r_[y, x]
    names = np.array(words, dtype=object)
    place = np.argsort(np.argsort(names)) if len(x) else x
    order = np.lexsort((place[y], -counts[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return pd.DataFrame({"word": names[x[first]], "k": np.diff(np.r_[first, len(x)]), "n": counts[y[first]], "form": names[y[first]]}).astype({"word": object, "form": object})


def upper_levels(paths: DataFrame) -> int:
    """The fewest levels by which no node of the trie holds more than NODE words (all, if there are none such)."""
    low, high = 1, GROUPS
    while low < high:
        middle = (low + high) // 2
        most = paths.groupBy(F.substring("path", 1, 4 * middle)).count().agg(F.max("count")).first()[0] or 0
        low, high = (low, middle) if most <= NODE else (middle + 1, high)
    return low


def variants(words: DataFrame) -> DataFrame:
    """One row per word of ``words`` (word, n; words distinct): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Near words are exactly one inserted, deleted or replaced code point apart. ``form`` is the near word of largest n (of
    equal ones the first in code-point order) if it is TIMES as frequent as the word at least, ``root`` the last of the
    chain of forms. Each form is TIMES as frequent as the one before, so a chain is short. Null words stay alone,
    other columns are ignored, and no words give no rows.
    """
    spark = words.sparkSession
    parts = partitions(spark)
    with arrow_batches(spark, 10_000):
        known = settle(words.select("word", "n", _paths("word").alias("path")).where("word is not null"))
        levels = upper_levels(known)
        dealt = known.mapInPandas(partial(_dealt, levels), "node long, word string, n long, path binary, spent int")
        near = dealt.repartition(parts, "node").groupBy("node").applyInPandas(lambda node: _near(levels, node), "word string, k long, n long, form string")
        found = settle(near)
    best = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best"))
    named = words.select("word", "n").join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    enough = F.col("form_n") >= TIMES * F.col("n")
    forms = settle(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps until no root has a form."""
    steps = settle(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("after"))
        moved = settle(steps.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps

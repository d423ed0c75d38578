"""Ranked lexical search by pair-bound MaxScore.

One scan turns each document into its terms' frequencies, restricted to terms that some query asks for; counts over
all documents give every term its weight. Documents then stay in the partitions they were read in. A task gathers
BLOCK of them into an inverted block: a list of (document, impact) for each term, its largest impact, and, for pairs of
terms that a query asks for together, the intersection of their lists with the largest joint impact.

Queries run against a block from their most selective term downwards. What the terms not yet read can add at most is a
sum over pairs, not over terms: no document has more from a pair than the larger of its joint maximum and each maximum
alone, which is less than both maxima together unless the same document has them. Once this bound falls below the
score of the k-th best document, unseen documents are skipped and only those already met are completed, each until its
own bound falls below. The k-th best score is carried from block to block of a task, and intersections give the first one.
Only the k best of each task and query leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import arrow_batches, settle

TOP = 10
BLOCK = 32_768
VOCABULARY = 500_000
SALTS = 32
# Bytes below 0x80 that end a term, and A-Z: fixed by the contract of the search.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of ASCII digits, letters (in lower case) and all non-ASCII."""
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _forward(numbers: Broadcast, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = numbers.value
    for batch in batches:
        lengths, terms, counts = [], [], []
        for text in batch["text"]:
            found = terms_of(text)
            wanted = Counter(filter(number.__contains__, found))
            lengths.append(len(found))
            terms.append([number[t] for t in wanted])
            counts.append(list(wanted.values()))
        yield pd.DataFrame({"doc": batch["doc"], "none": batch["none"], "n": lengths, "terms": terms, "counts": counts})


class Block:
    """Inverted lists of some documents; ``impacts`` of a term's list are its shares of the scores."""

    def __init__(self, size: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        order = np.argsort(terms, kind="stable")
        some = order[impacts[order] > 0]
        self.size, terms, self.docs, self.impacts = size, terms[some], docs[some], impacts[some]
        names, starts = np.unique(terms, return_index=True)
        self.at = {int(t): slice(a, b) for t, a, b in zip(names, starts, np.r_[starts[1:], len(terms)])}
        most = np.maximum.reduceat(self.impacts, starts) if len(starts) else starts
        self.most = dict(zip(self.at, most.tolist()))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self._dense = np.zeros(size, dtype=np.int64)

    def joint(self, a: int, b: int, k: int) -> tuple[int, int]:
        """Of the intersection of two lists: what a document can have from both terms at most, and the k-th best of it."""
        key = (min(a, b), max(a, b))
        if key not in self.pairs:
            left, right = self.at[key[0]], self.at[key[1]]
            self._dense[self.docs[left]] = self.impacts[left]
            of = self._dense[self.docs[right]]
            both = of[of > 0] + self.impacts[right][of > 0]
            self._dense[self.docs[left]] = 0
            kth = int(np.partition(both, len(both) - k)[len(both) - k]) if len(both) >= k else 0
            self.pairs[key] = max(self.most[a], self.most[b], int(both.max(initial=0))), kth
        return self.pairs[key]

    def ordered(self, query: np.ndarray, k: int) -> tuple[list[int], list[int], int]:
        """The query's terms in the block, most selective first, what those from each place on can add at most, and a
        score that k documents reach at least."""
        terms = sorted((int(t) for t in query if int(t) in self.at), key=lambda t: (-self.most[t], t))
        left, reached = [0] * (len(terms) + 1), 0
        for i in range(len(terms) - 1, -1, -1):
            if (len(terms) - i) % 2:
                left[i] = self.most[terms[i]] + left[i + 1]
            else:
                most, kth = self.joint(terms[i], terms[i + 1], k)
                left[i], reached = most + left[i + 2], max(reached, kth)
        return terms, left, reached

    def best(self, query: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all that have at least ``least`` and belong to the block's k best, equal scores of the
        k-th included."""
        terms, left, reached = self.ordered(query, k)
        least, sums, i = max(least, reached, 1), self._dense, 0
        met = np.zeros(0, dtype=np.int64)
        while i < len(terms) and left[i] >= least:
            docs = self.docs[self.at[terms[i]]]
            met = np.concatenate([met, docs[sums[docs] == 0]])
            sums[docs] += self.impacts[self.at[terms[i]]]
            least, i = max(least, _kth(sums[met], k)), i + 1
        scores = sums[met]
        sums[met] = 0
        while True:
            keep = scores + left[i] >= least
            met, scores = met[keep], scores[keep]
            if i == len(terms) or not len(met):
                return met, scores
            docs, impacts = self.docs[self.at[terms[i]]], self.impacts[self.at[terms[i]]]
            place = np.minimum(np.searchsorted(docs, met), len(docs) - 1)
            scores = scores + np.where(docs[place] == met, impacts[place], 0)
            least, i = max(least, _kth(scores, k)), i + 1


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _first(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["score", "none", "doc"], ascending=[False, True, True], kind="stable").head(k)


def _ranked(k: int, n_docs: int, n_terms: int, weights: Broadcast, queries: Broadcast, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The k best of the task's documents for each query, from one block after the other."""
    heavy: np.ndarray = weights.value
    held: list[pd.DataFrame] = []
    tops = [pd.DataFrame() for _ in queries.value]

    def search() -> None:
        rows = pd.concat(held, ignore_index=True)
        held.clear()
        sizes = rows["terms"].map(len).to_numpy()
        of = np.repeat(np.arange(len(rows)), sizes)
        terms = np.concatenate([np.zeros(0, dtype=np.int64), *rows["terms"]]).astype(np.int64)
        tf = np.concatenate([np.zeros(0, dtype=np.int64), *rows["counts"]]).astype(np.int64)
        m = 10 + 90 * rows["n"].to_numpy(np.int64) * n_docs // n_terms
        block = Block(len(rows), terms, of, heavy[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of])))
        for q, query in enumerate(queries.value):
            least = int(tops[q]["score"].iloc[-1]) if len(tops[q]) == k else 1
            docs, scores = block.best(query, k, least)
            if len(docs):
                found = rows[["doc", "none"]].iloc[docs].assign(score=scores)
                tops[q] = _first(pd.concat([tops[q], found]) if len(tops[q]) else found, k)

    for batch in batches:
        held.append(batch[batch["terms"].map(len) > 0])
        if sum(map(len, held)) >= BLOCK:
            search()
    if held:
        search()
    for q, top in enumerate(tops):
        if len(top):
            yield pd.DataFrame({"query": q, "doc": top["doc"], "none": top["none"], "score": top["score"]})


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_col``, ``rank`` (int, from 1), ``id_col``, ``score`` (long).

    Scores are whole numbers as ``weight`` and ``_ranked`` compute them, equal ones are ordered by id, null ids last. Null
    and empty texts have no terms: such documents are not counted and such items find nothing. Repeated rows are documents
    (or items) of their own; a repeated item has each rank once for each of its rows. Other columns are ignored,
    whatever their names. An empty table on either side gives an empty result.

    Items are searched for in groups of about VOCABULARY terms, so that what is broadcast has a bound; each group
    takes one scan. A document's terms are all read at once, in batches bounded in bytes.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    asked = settle(asked)
    words = asked.select("row", "item", F.explode(_distinct_terms("text")).alias("term"))
    groups = max(1, -(-words.count() // VOCABULARY))
    found = [_group(docs, words.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g), k, id_col, text_col) for g in range(groups)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = [F.desc("score"), F.asc("none"), F.asc("doc")]
    part = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("row", part).orderBy(*best))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).where(F.col("rank") <= k)
    named = ranked.join(asked.select("row", "item"), "row")
    return named.select(F.col("item").alias(item_col), "rank", F.when(~F.col("none"), F.col("doc")).alias(id_col), "score")


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _distinct_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(terms_of(t))) for t in texts], dtype=object)


def _group(docs: DataFrame, words: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, score): the k best of each task for each item of ``words`` (row, term), which fit the driver."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    asked = words.groupBy("row").agg(F.collect_list("term").alias("terms")).collect()
    numbers = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for r in asked for t in r["terms"]}))}
    doc = F.col(id_col)
    texts = docs.select(F.coalesce(doc, F.lit(0).cast(kind)).alias("doc"), doc.isNull().alias("none"), F.col(text_col).cast("binary").alias("text"))
    schema = f"doc {kind}, none boolean, n long, terms array<int>, counts array<int>"
    with arrow_batches(spark, 1000):
        forward = settle(texts.mapInPandas(partial(_forward, sc.broadcast(numbers)), schema).where("n > 0"))
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    frequency = forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(numbers)), dtype=np.int64)
    for term, df in frequency:
        weights[term] = weight(n_docs, df)
    queries = [np.array([numbers[bytes(t)] for t in r["terms"]], dtype=np.int64) for r in asked]
    rank = partial(_ranked, k, n_docs, n_terms or 1, sc.broadcast(weights), sc.broadcast(queries))
    tops = forward.mapInPandas(rank, f"query int, doc {kind}, none boolean, score long")
    of = spark.createDataFrame([(q, r["row"]) for q, r in enumerate(asked)], "query int, row long")
    return settle(tops.join(of, "query").select("row", "doc", "none", "score"))

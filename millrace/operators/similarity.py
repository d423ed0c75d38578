"""Retrieval and similarity: sparse scores meet over shared terms, dense ones in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.functions.columns import checkpointed

BLOCK = 2000
BATCH_BYTES = 32 << 20  # of blocks that a task holds at once
HELD = 400_000  # rows that are sent to all tasks, at most
PARTS_FACTOR = 6  # partitions of parts for each of texts


def _held(frame: DataFrame) -> DataFrame:
    """``frame`` written once; sent to all tasks if it has at most HELD rows."""
    kept = checkpointed(frame)
    return F.broadcast(kept) if kept.limit(HELD + 1).count() <= HELD else kept


def _parts(targets: DataFrame, chunk: int | None) -> DataFrame:
    """(target, part, text): whole texts, or parts of ``chunk`` words, dealt by their target before anything is exploded.

    All that is counted, met and summed up for a target afterwards stays in its partition.
    """
    texts = targets.select(F.col("id").alias("target"), "text")
    if chunk is None:
        return texts.repartition("target").withColumn("part", F.lit(0))
    # the pairs of many parts: smaller partitions hold their sums in memory
    dealt = texts.repartition(PARTS_FACTOR * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target")
    return dealt.select("target", F.posexplode(fn.chunks(F.col("text"), chunk)).alias("part", "text"))


def keyword_scores(queries: DataFrame, targets: DataFrame, stop: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """(query, target, score): Jaccard similarity of token sets, for pairs that share a token.

    Both frames have ``id`` and ``text``. Pairs without a shared token score zero and have no row. With ``chunk`` a target
    scores as its best part of so many words. Only the texts of the targets are shuffled.
    """

    def words(texts: DataFrame, *keys: str) -> DataFrame:
        return texts.select(*keys, fn.tokens(F.col("text"), stop).alias("w")).select(*keys, F.size("w").alias("n"), F.explode("w").alias("w"))

    q = words(queries.select(F.col("id").alias("query"), "text"), "query").withColumnRenamed("n", "qn")
    t = words(_parts(targets, chunk), "target", "part").withColumnRenamed("n", "tn")
    shared = t.join(_held(q), "w").groupBy("query", "target", "part").agg(F.count("*").alias("shared"), F.first("qn").alias("qn"), F.first("tn").alias("tn"))
    scores = shared.select("query", "target", (F.col("shared") / (F.col("qn") + F.col("tn") - F.col("shared"))).alias("score"))
    return scores if chunk is None else scores.groupBy("query", "target").agg(F.max("score").alias("score"))


def _term_counts(texts: DataFrame, stop: Sequence[str], *keys: str) -> DataFrame:
    """(keys, term, tf) of the texts."""
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2)
    return texts.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _idf(n: Column) -> Column:
    return F.log((1 + n) / (1 + F.col("df"))) + 1


def term_weights(texts: DataFrame, stop: Sequence[str] = (), sublinear: bool = False, least: int = 1) -> DataFrame:
    """(side, id, term, weight): L2-normalised tf-idf, idf = ln((1 + n) / (1 + df)) + 1, over all of ``texts`` (side, id, text)."""
    counts = _term_counts(texts, stop, "side", "id")
    n = texts.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).join(F.broadcast(n))
    idf = df.select("term", _idf(F.col("n")).alias("idf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(idf, "term").select("side", "id", "term", (tf * F.col("idf")).alias("w"))
    norms = raw.groupBy("side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ["side", "id"]).select("side", "id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_scores(queries: DataFrame, targets: DataFrame, stop: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """(query, target, score): tf-idf cosine, fitted on queries and targets together, for pairs that share a term.

    With ``chunk`` the parts of so many words are the targets, and a target scores as its best one. The texts of the
    targets are shuffled, and of their terms the rare ones: terms in more than one of HELD (text, term) pairs, HELD at
    most, are sent to all tasks with their idf, and of the others only squares come back to the targets.
    """
    parts = _parts(targets, chunk)
    q, t = _term_counts(queries.select(F.col("id").alias("query"), "text"), stop, "query"), _term_counts(parts, stop, "target", "part")
    met = q.select("term").unionByName(t.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = queries.count() + (targets.count() if chunk is None else parts.count())
    idf = checkpointed(met.select("term", "df", _idf(F.lit(n)).alias("idf")))
    least = (idf.agg(F.sum("df")).first()[0] or 0) / HELD
    often, rare = F.broadcast(idf.where(F.col("df") > least).select("term", "idf")), idf.where(F.col("df") <= least).select("term", "idf")
    weight = F.col("tf") * F.col("idf")

    def squares(counts: DataFrame, of: DataFrame) -> DataFrame:
        return counts.join(of, "term").groupBy("target", "part").agg(F.sum(weight * weight).alias("square"))

    both = squares(t, often).unionByName(squares(t.join(often, "term", "left_anti"), rare)).groupBy("target", "part").agg(F.sqrt(F.sum("square")).alias("norm"))
    norms = both.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("part", "norm"))).alias("norms"))
    raw = q.join(idf, "term").select("query", "term", "idf", weight.alias("qw"))
    own = raw.join(raw.groupBy("query").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn")), "query").select("query", "term", "idf", (F.col("qw") / F.col("qn")).alias("qw"))
    sums = t.join(_held(own), "term").groupBy("query", "target", "part").agg(F.sum(F.col("qw") * weight).alias("dot"))
    scores = sums.join(norms.hint("shuffle_hash"), "target").select("query", "target", (F.col("dot") / F.try_element_at("norms", F.col("part"))).alias("score"))
    return scores if chunk is None else scores.groupBy("query", "target").agg(F.max("score").alias("score"))


def top_k(scores: DataFrame, k: int, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """The k best targets of each query: rounded score, ties to the smaller target, the threshold after the cut."""
    rounded = scores.withColumn("score", F.round("score", digits))
    best = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def _spreads(scores: DataFrame, targets: int | Column) -> DataFrame:
    """(query, spread, nothing): the deviation of a query's scores over all ``targets``, and the z-score of those without a row."""
    n = F.lit(targets) if isinstance(targets, int) else targets
    sums = scores.groupBy("query").agg((F.sum("score") / n).alias("mean"), (F.sum(F.col("score") * F.col("score")) / n).alias("square"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))) + 1e-9
    return _held(sums.select("query", "mean", spread.alias("spread")).select("query", "spread", (-F.col("mean") / F.col("spread")).alias("nothing")))


def zscores(scores: DataFrame, targets: int | Column) -> DataFrame:
    """Scores as z-scores of their query over all ``targets``, of which those without a row score zero."""
    return scores.join(_spreads(scores, targets), "query").select("query", "target", (F.col("score") / F.col("spread") + F.col("nothing")).alias("score"), "nothing")


def fuse(matrices: Sequence[DataFrame], targets: int) -> DataFrame:
    """(query, target, score): the sum of the methods' z-scores, for pairs that any method scores.

    Means and spreads are settled first, one row a query; pairs are not moved for them, nor to be added up where each
    matrix has them dealt by target.
    """
    spreads = [_spreads(m, targets) for m in matrices]
    gains = [m.join(s, "query").select("query", "target", (F.col("score") / F.col("spread")).alias("gain")) for m, s in zip(matrices, spreads)]
    floor = _held(reduce(DataFrame.unionByName, [s.select("query", "nothing") for s in spreads]).groupBy("query").agg(F.sum("nothing").alias("floor")))
    return reduce(DataFrame.unionByName, gains).groupBy("query", "target").agg(F.sum("gain").alias("gain")).join(floor, "query").select("query", "target", (F.col("gain") + F.col("floor")).alias("score"))


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _block(frame: DataFrame) -> tuple[int, Column]:
    """Into how many blocks of about BLOCK rows ``frame`` is dealt, and the block of a row."""
    n = max(1, -(-frame.count() // BLOCK))
    return n, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _best(k: int, group: pd.DataFrame) -> pd.DataFrame:
    q, t = (group[group["side"] == s] for s in (0, 1))
    if not len(q) or not len(t):
        return pd.DataFrame({"query": [], "target": [], "score": []})
    ids, targets = q["id"].to_numpy(), t["id"].to_numpy()
    scores = np.round(unit(q["vector"]) @ unit(t["vector"]).T, 6)
    scores[ids[:, None] == targets[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(targets, scores.shape), -scores), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), order.shape[1])
    found = pd.DataFrame({"query": ids[rows], "target": targets[order.ravel()], "score": scores[rows, order.ravel()]})
    return found[found["score"] > -np.inf]


def vector_top_k(table: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows by cosine of each query (both id, vector), itself left out.

    Both are dealt to blocks of about BLOCK rows; a task holds a block of each and keeps its k best of each query, and
    one ranking a query is left. Zero vectors score zero.
    """
    (nq, q), (nt, t) = _block(queries), _block(table)
    left = queries.select(q.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("t"), F.lit(0).alias("side"), "id", "vector")
    right = table.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), t.alias("t"), F.lit(1).alias("side"), "id", "vector")
    both = left.unionByName(right)
    return top_k(both.groupBy("q", "t").applyInPandas(partial(_best, k), "query long, target long, score double"), k)


def _pairs(threshold: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs between two blocks a row, each block with its ids and its vectors end to end."""
    for batch in batches:
        for row in batch.itertuples():
            a, b = (unit(np.reshape(v, (len(ids), -1))) for v, ids in ((row.a, row.a_ids), (row.b, row.b_ids)))
            scores = a @ b.T
            i, j = np.nonzero(scores >= threshold)
            left, right = np.asarray(row.a_ids)[i], np.asarray(row.b_ids)[j]
            keep = left < right if row.x == row.y else left != right
            yield pd.DataFrame({"left": np.minimum(left, right)[keep], "right": np.maximum(left, right)[keep], "score": scores[i, j][keep]})


def similarity_join(table: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """(left, right, score): pairs with left < right and low <= cosine < high, compared block by block.

    Rows are dealt to blocks of about BLOCK by a hash and written once, a row a block; each two blocks meet once, in a task
    that reads them from there, so no vector is copied for the blocks it meets. The work is quadratic.
    """
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = table.select("id", "vector", _block(table)[1].alias("block")).groupBy("block").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    blocks = checkpointed(rows.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("flat")))
    left, right = (blocks.select(F.col("block").alias(k), F.col("ids").alias(f"{v}_ids"), F.col("flat").alias(v)) for k, v in (("x", "a"), ("y", "b")))
    out = left.join(right, F.col("x") <= F.col("y")).mapInPandas(partial(_pairs, low - 1e-7), "left long, right long, score double")
    return out if high is None else out.where(F.col("score") < high)


def centroids(table: DataFrame, group: str) -> DataFrame:
    """(group, dim, value): the mean vector of each group, scaled to unit length; a zero mean stays zero."""
    means = table.select(group, F.posexplode("vector").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norms = means.groupBy(group).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return means.join(norms, group).select(group, "dim", F.when(F.col("norm") == 0, 0.0).otherwise(F.col("mean") / F.col("norm")).alias("value"))


def candidates(sources: DataFrame, targets: DataFrame, method: str = "tfidf", k: int = 10, threshold: float | None = None, chunk: int = 60, stop: Sequence[str] = ()) -> DataFrame:
    """(query, target, score, rank): the ``k`` likeliest targets of each source (both id, text) by ``keyword``, ``tfidf`` or ``hybrid``.

    A target scores as its best part of ``chunk`` words; the threshold comes after the cut. Pairs without a shared
    word have no row.
    """
    methods = {"keyword": (keyword_scores,), "tfidf": (tfidf_scores,), "hybrid": (keyword_scores, tfidf_scores)}[method]
    scores = [score(sources, targets, stop, chunk) for score in methods]
    return top_k(scores[0] if len(scores) == 1 else fuse(scores, targets.count()), k, threshold)

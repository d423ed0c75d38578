"""Selection by quotas in hash order that passes over near duplicates of what is chosen already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed
from millrace.functions.text import tokens
from millrace.operators.corpus import first_per_key, hash_order

PARTS = 1024


def jaccard_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of ``sets`` (key, tokens: distinct strings) whose Jaccard similarity is ``threshold`` or more.

    Tokens stand in the order of their frequency, rare ones first. Two similar sets share a token among the first
    n - ceil(threshold n) + 1 of either, so only these are joined, and only sets of similar size; candidates are checked
    whole. Empty sets and those that are null are similar to none.
    """
    long = sets.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("token"))
    seldom = long.join(long.groupBy("token").agg(F.count("*").alias("n")), "token")
    ordered = seldom.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "token")))["token"].alias("tokens"))
    ordered = checkpointed(ordered.withColumn("size", F.size("tokens")))
    short = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    first = ordered.select("key", "size", F.explode(F.slice("tokens", F.lit(1), short.cast("int"))).alias("token"))
    other = first.select("token", F.col("key").alias("b"), F.col("size").alias("b_size"))
    met = first.withColumnsRenamed({"key": "a", "size": "a_size"}).join(other, "token").where(F.col("a") < F.col("b"))
    near = met.where(F.least("a_size", "b_size") >= threshold * F.greatest("a_size", "b_size") - 1e-9).select("a", "b").distinct()
    whole = near.join(ordered.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(ordered.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return whole.where(both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``nodes`` (key, place), those that a walk in the order of ``place`` keeps if it passes over each that has an
    edge (a, b) with one it has kept. Places differ.

    In rounds: what has no undecided neighbour before it stays, what has a neighbour that stays goes. If the order is random
    the number of rounds grows with the logarithm of that of the nodes.
    """
    at = lambda side: nodes.select(F.col("key").alias(side), F.col("place").alias(f"{side}_place"))
    both = edges.join(at("a"), "a").join(at("b"), "b")
    earlier = F.col("a_place") < F.col("b_place")
    after = checkpointed(both.select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("after")))
    bound = checkpointed(after.select(F.col("after").alias("key")).distinct())
    kept = nodes.join(bound, "key", "left_anti").select("key")
    new, left = kept, bound
    while not left.isEmpty():
        gone = after.join(new.select(F.col("key").alias("before")), "before", "left_semi").select(F.col("after").alias("key"))
        left = checkpointed(left.join(gone, "key", "left_anti"))
        waiting = after.join(left.select(F.col("key").alias("before")), "before", "left_semi").select(F.col("after").alias("key"))
        new = checkpointed(left.join(waiting, "key", "left_anti"))
        left = checkpointed(left.join(new, "key", "left_anti"))
        kept = kept.unionByName(new)
    return nodes.join(kept, "key", "left_semi")


def first_in_order(rows: DataFrame, order: str, n: int, share: float = 1.0) -> DataFrame:
    """The ``n`` rows that come first by ``order``, a hash in hex digits of which all are below the ``share`` of its range.

    Rows are counted by parts of the range; whole parts stay or go, and only the part that the quota cuts is ranked.
    """
    part = F.least(F.floor(_fraction(F.col(order)) / share * PARTS), F.lit(PARTS - 1)).cast("int")
    parted = rows.withColumn("_part", part)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_before"])
    met = parted.join(F.broadcast(before.where(F.col("_before") < n)), "_part")
    whole = met.where(F.col("_before") + F.col("_n") <= n)
    cut = met.where(F.col("_before") + F.col("_n") > n).withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return whole.unionByName(cut.where(F.col("_before") + F.col("_rank") <= n).drop("_rank")).drop("_part", "_n", "_before")


def _fraction(order: Column) -> Column:
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)


def select_by_quota(
    rows: DataFrame, key: str, stratum: str, text: str, quotas: Sequence[tuple[str, int]], seed: str, threshold: float | None = None, words: tuple[int, int] = (6, 60), fallback: str | None = None
) -> DataFrame:
    """Up to a quota of rows (columns of ``rows``) from each stratum: the same that a walk picks which takes stratum after
    stratum, row after row in the order of the keyed hash, and passes over texts whose token sets have the
    Jaccard similarity ``threshold`` or more to one it has picked, in whatever stratum.

    Only texts of so many words count, and of equal texts (by letters and digits) the one with the smallest key. What
    earlier strata lack of their quotas is added to that of ``fallback``. Strata without a quota, null ones and null texts are not
    chosen from. Keys are unique.

    A stratum is read as far as its quota needs: first the part of the hash range that holds twice the quota, then
    twice as much, until enough is found. No step sorts or holds a stratum in one task.
    """
    count = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    same = F.sha2(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]", ""), 256)
    long = rows.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), tokens(F.col(text)).alias("tokens"), count.alias("words"), same.alias("same"))
    fit = long.where(F.col("words").between(*words) & F.col("stratum").isin([s for s, _ in quotas]))
    pool = checkpointed(first_per_key(fit, ["same"], [F.col("key")]).withColumn("order", hash_order(seed, F.col("key"))).select("key", "stratum", "tokens", "order"))
    sizes = dict(pool.groupBy("stratum").count().collect())
    taken, lacking = None, 0
    for name, quota in quotas:
        size, wanted = sizes.get(name, 0), quota + (lacking if name == fallback else 0)
        own, share = pool.where(F.col("stratum") == name), min(1.0, (2 * wanted + 20) / max(size, 1))
        while True:
            near = checkpointed(own.where(_fraction(F.col("order")) < share) if share < 1 else own)
            if threshold is not None:
                place = F.concat(F.lit("1"), F.col("order"))
                nodes = near.select("key", "tokens", place.alias("place"))
                if taken is not None:
                    nodes = nodes.unionByName(taken.select("key", "tokens", F.concat(F.lit("0"), F.col("order")).alias("place")))
                picked = first_independent(nodes.select("key", "place"), checkpointed(jaccard_links(nodes, threshold)))
                near = checkpointed(near.join(picked.select("key"), "key", "left_semi"))
            found = near.count()
            if found >= wanted or share >= 1:
                break
            share = min(1.0, 2 * share)
        got = checkpointed(first_in_order(near, "order", wanted, share))
        lacking += max(0, quota - found) if name != fallback else 0
        taken = got if taken is None else taken.unionByName(got)
    if taken is None:
        return rows.limit(0)
    return rows.join(taken.select(F.col("key").alias(key)), key, "left_semi")

"""Metrics of directed graphs: edges are (src, dst), nodes a frame with the column ``node``.

The iterative ones keep their state in frames, one row a node (or a pair of nodes where the result needs pairs), and
checkpoint it every round, so a plan never grows with the rounds and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed, ratio
from millrace.operators.ranks import running_sum


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out, total coupling and instability of every node; edges are made distinct, loops dropped."""
    own = edges.select("src", "dst").where("src <> dst").distinct()
    ends = own.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(own.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counts = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    all_ = nodes.join(counts, "node", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return all_.withColumn("total_coupling", total).withColumn("instability", ratio(F.col("fan_out"), total).cast("double"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(node, rank): dangling nodes give their rank to all alike; stops once no rank changes by ``tolerance``."""
    links = edges.select("src", "dst").distinct()
    links = checkpointed(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"))
    n = nodes.count()
    ranks = checkpointed(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank")))
    ends = links.select(F.col("src").alias("node")).distinct()
    for _ in range(rounds):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        loose = ranks.join(ends, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * loose / n if n else 0.0
        new = ranks.withColumnRenamed("rank", "old").join(given, F.col("node") == F.col("dst"), "left")
        new = checkpointed(new.select("node", "old", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank")))
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("node", "rank")
        if change is None or change < tolerance:
            break
    return ranks


def _least_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node from which each node is reachable, itself included."""
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        sent = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("root").alias("sent"))
        new = labels.join(sent, labels["node"] == sent["dst"], "left").select("node", F.least("root", "sent").alias("new"), "root")
        hop = new.select(F.col("node").alias("via"), F.col("new").alias("further"))
        new = checkpointed(new.join(hop, new["new"] == hop["via"]).select("node", F.least("new", "further").alias("new"), "root"))
        if new.where("new <> root").isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("root"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component_id): root is the smallest member, ids count components by it from 0."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = _least_reachable(nodes, both)
    numbers = running_sum(labels.select("root").distinct(), ["root"], "_n").select("root", (F.col("_n") - 1).cast("int").alias("component_id"))
    return labels.join(numbers, "root").select("node", "root", "component_id")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): strongly connected components named by a member.

    Colouring: each node takes the smallest node that reaches it; those that reach that node back within their
    colour are its component and leave; the rest goes on.
    """
    left = checkpointed(nodes.select("node"))
    edges = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        colour = _least_reachable(left, edges)
        a, b = (colour.select(F.col("node").alias(k), F.col("root").alias(f"c_{k}")) for k in ("src", "dst"))
        within = checkpointed(edges.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("root")))
        reached = checkpointed(colour.where("node = root"))
        front = reached
        while not front.isEmpty():
            back = within.join(front.select(F.col("node").alias("dst"), "root"), ["dst", "root"]).select(F.col("src").alias("node"), "root").distinct()
            front = checkpointed(back.join(reached, ["node", "root"], "left_anti"))
            reached = checkpointed(reached.unionByName(front))
        done = reached if done is None else done.unionByName(reached)
        left = checkpointed(left.join(reached.select("node"), "node", "left_anti"))
        keep = left.select(F.col("node").alias("k"))
        edges = checkpointed(edges.join(keep, edges["src"] == keep["k"], "left_semi").join(keep, edges["dst"] == keep["k"], "left_semi"))
    return done if done is not None else nodes.select("node", F.col("node").alias("root"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per strongly connected component of two or more nodes: root, members, size, internal edges."""
    parts = checkpointed(strong_components(nodes, edges))
    groups = parts.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size")).where("size > 1")
    a, b = (parts.select(F.col("node").alias(k), F.col("root").alias(f"r_{k}")) for k in ("src", "dst"))
    inner = edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst").where("r_src = r_dst").groupBy(F.col("r_src").alias("root")).agg(F.count("*").alias("internal_edges"))
    return groups.join(inner, "root").select(F.array_join("members", ";").alias("members"), "size", "internal_edges")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, betweenness) over directed shortest paths, scaled by 1 / ((n-1)(n-2)); zero for two nodes or fewer.

    Level-synchronous Brandes for all sources at once: one frame a level holds (source, node, paths), and the
    dependencies flow back level by level.
    """
    links = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    n = nodes.count()
    levels = [checkpointed(nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    while True:
        last = levels[-1]
        step = last.join(links, last["v"] == links["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        step = checkpointed(step.join(seen, ["s", "v"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = checkpointed(seen.unionByName(step.select("s", "v")))
    total = None
    after = levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[1:-1]):
        far = after.select("s", F.col("v").alias("w"), F.col("paths").alias("w_paths"), F.col("share").alias("w_share"))
        flow = level.join(links, level["v"] == links["src"]).join(far, (F.col("dst") == F.col("w")) & (level["s"] == far["s"]))
        share = flow.groupBy(level["s"], level["v"]).agg(F.sum(F.col("paths") / F.col("w_paths") * (1 + F.col("w_share"))).alias("share"))
        after = checkpointed(level.join(share, ["s", "v"], "left").na.fill(0.0, ["share"]))
        part = after.select(F.col("v").alias("node"), "share")
        total = part if total is None else total.unionByName(part)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("node").agg(F.sum("share").alias("share"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))

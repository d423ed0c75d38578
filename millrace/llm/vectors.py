"""Near-duplicate vectors through coarse lists with product-quantised residuals and an exact rerank.

* Equal vectors are one entry with a count, so copies cost nothing below.
* A coarse quantiser (k-means on a bounded sample) puts each unit vector x into the list of its nearest centroid. A
  partner in another list lies across the border of both lists, and the middle of the two vectors lies on one side
  of it. A vector probes all lists whose side the middle to some partner within the threshold's angle can reach,
  in whatever direction the partner lies. So at least one of both probes the other's list, and no link is missed,
  however the vectors are spread. Which lists a vector probes is settled once and travels with it.
* In a list, vectors are stored as residuals to the centroid, coded by one of ``CODES`` codewords in each of ``PARTS``
  subspaces (codebooks from the same sample), with the length of what the code leaves out. A table of the products of
  the probing vector with all codewords gives the distance to each coded vector by look-ups; for a block of vectors, the
  look-ups are one product of tables and code indicators. The true distance differs by at most the left-out length,
  so what lies farther than r plus that length is no link; what is left is reranked by the exact cosine in double
  precision.
* Lists are dealt in groups of near centroids, so a vector is sent once to a group and not to every list there. Groups
  are cut into blocks of at most ``BLOCK`` vectors, and blocks of probes meet blocks of members in a join whose
  keys are salted. A task sends on the number of links of each vector and a spanning forest of the links, never the
  links of a dense group.

The number of lists is the square root of the number of vectors, up to an eighth of the sample; the work grows with
vectors times the members of the probed lists. How many lists are probed depends on the spread of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, partitions, settle, small_batches
from millrace.llm.simhash import forest

THRESHOLD = 0.9
SAMPLE = 20_000
PARTS = 16
CODES = 16
BLOCK = 1024
BLOCKS_AT_ONCE = 8
ROUNDS = 8
SLACK = 1e-4
SPAN = 1e-12


def _kmeans(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of a bounded sample, started from evenly spaced members of it."""
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(points, centroids)
        order = np.argsort(nearest, kind="stable")
        seen, start = np.unique(nearest[order], return_index=True)
        centroids[seen] = np.add.reduceat(points[order], start, axis=0) / np.diff(np.r_[start, len(points)])[:, None]
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points @ centroids.T * 2 - (centroids**2).sum(axis=1)).argmax(axis=1)


class Quantiser:
    """Coarse centroids in groups, and residual codebooks, trained on at most ``SAMPLE`` unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        lists = int(min(max(1, np.sqrt(rows)), max(1, len(sample) // 8)))
        self.centroids = _kmeans(sample, lists)
        self.sizes = (self.centroids**2).sum(axis=1)
        self.groups = _nearest(self.centroids, _kmeans(self.centroids, int(np.ceil(np.sqrt(len(self.centroids))))))
        residuals = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [_kmeans(residuals[:, c], CODES) for c in self.cuts]

    def probes(self, units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each vector, and which other lists it probes (vector, list).

        The middle of x and a partner at the angle p is ``((1 + cos p) x + sin p u) / 2`` with a unit vector u across x.
        """
        own = _nearest(units, self.centroids)
        dots = units @ self.centroids.T
        mine = np.arange(len(units))
        along = dots - dots[mine, own][:, None]
        gaps = self.sizes[own][:, None] + self.sizes - 2 * self.centroids[own] @ self.centroids.T
        across = np.sqrt(np.maximum(0, gaps - along**2))
        angle = np.minimum(np.arccos(np.clip(threshold, -1, 1)), np.arctan2(across, along))
        reached = ((1 + np.cos(angle)) * along + np.sin(angle) * across) / 2 + SLACK >= (self.sizes - self.sizes[own][:, None]) / 2
        reached[mine, own] = False
        return own, reached

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indicators (vector, codeword of each part), what the codes leave out, and the codes' squared lengths."""
        wide = sum(len(b) for b in self.books)
        shown, left, length, at = np.zeros((len(residuals), wide), dtype=np.float32), np.zeros(len(residuals)), np.zeros(len(residuals)), 0
        for cut, book in zip(self.cuts, self.books):
            code = _nearest(residuals[:, cut], book)
            left += ((residuals[:, cut] - book[code]) ** 2).sum(axis=1)
            length += (book**2).sum(axis=1)[code]
            shown[np.arange(len(residuals)), at + code] = 1
            at += len(book)
        return shown, np.sqrt(left), length

    def tables(self, units: np.ndarray) -> np.ndarray:
        """Products of each vector's parts with all codewords."""
        return np.concatenate([units[:, cut] @ book.T for cut, book in zip(self.cuts, self.books)], axis=1).astype(np.float32)


def _vectors(column: pd.Series, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=kind) for x in column])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; components are scaled first, so that no square is lost or overflows."""
    both = vectors.astype(np.float64)
    both = both / np.abs(both).max(axis=1, keepdims=True)
    return both / np.linalg.norm(both, axis=1, keepdims=True)


DEALT = "part int, role int, list int, entry long, copies long, vector binary, probed binary"


def _dealt(quantiser: Quantiser, threshold: float, kind: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each entry as a member (role 0) of its own group, and one (role 1) for each group in which it probes a list."""
    groups = np.unique(quantiser.groups)
    of = np.equal.outer(quantiser.groups, groups)
    for batch in batches:
        if not len(batch):
            continue
        own, reached = quantiser.probes(_unit(_vectors(batch["vector"], kind)), threshold)
        packed = np.packbits(reached, axis=1, bitorder="little")
        rows = batch.assign(list=own, probed=[x.tobytes() for x in packed])
        yield rows.assign(part=quantiser.groups[own], role=0)[[c.split()[0] for c in DEALT.split(", ")]]
        row, group = np.nonzero(reached.astype(np.float32) @ of.astype(np.float32) > 0)
        yield rows.iloc[row].assign(part=groups[group], role=1)[[c.split()[0] for c in DEALT.split(", ")]]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group, role and list as blocks; a block mixes neither groups nor roles."""
    held: list[pd.DataFrame] = []
    key, size = None, 0

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal held, size
        if size:
            rows = pd.concat(held)
            heads = np.stack([rows[c].to_numpy("<i8") for c in ("entry", "copies", "list")])
            data = np.array([size, len(rows["probed"].iloc[0])], dtype="<i8").tobytes() + heads.tobytes() + b"".join(rows["probed"]) + b"".join(rows["vector"])
            yield pd.DataFrame({"part": [key[0]], "role": [key[1]], "low": [int(rows["list"].min())], "high": [int(rows["list"].max())], "least": [int(rows["entry"].iloc[0])], "block": [data]})
            held, size = [], 0

    for batch in batches:
        for now, rows in batch.groupby(["part", "role"], sort=False):
            at = 0
            while at < len(rows):
                if now != key or size == BLOCK:
                    yield from flush()
                    key = now
                take = min(BLOCK - size, len(rows) - at)
                held.append(rows.iloc[at : at + take])
                size, at = size + take, at + take
    yield from flush()


class _Block:
    """Entries, copies, lists, probed lists and unit vectors of a block."""

    def __init__(self, packed: bytes, kind: str) -> None:
        n, wide = (int(x) for x in np.frombuffer(packed, dtype="<i8", count=2))
        self.entries, self.copies, self.lists = np.frombuffer(packed, dtype="<i8", count=3 * n, offset=16).reshape(3, n)
        self.probed = np.frombuffer(packed, dtype=np.uint8, count=wide * n, offset=16 + 24 * n).reshape(n, wide)
        self.units = _unit(np.frombuffer(packed, dtype=kind, offset=16 + (24 + wide) * n).reshape(n, -1))

    def probes(self, of: int) -> np.ndarray:
        return (self.probed[:, of >> 3] >> (of & 7)) & 1 == 1


def _exact(a: np.ndarray, b: np.ndarray, near: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``near`` whose cosine reaches the threshold."""
    if 32 * np.count_nonzero(near) > near.size:
        cosines = a @ b.T
        i, j = np.nonzero(near & (cosines >= threshold - SPAN))
        edge = np.flatnonzero(cosines[i, j] < threshold + SPAN)
    else:
        i, j = np.nonzero(near)
        edge = np.arange(len(i))
    good = np.ones(len(i), dtype=bool)
    for at in range(0, len(edge), 1 << 16):
        some = edge[at : at + (1 << 16)]
        good[some] = np.einsum("ij,ij->i", a[i[some]], b[j[some]]) >= threshold
    return i[good], j[good]


def _compared(quantiser: Quantiser, threshold: float, kind: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of blocks of one group: links of each entry, and a forest of them.

    A link between two lists can be found from both sides. Then each side counts its own; if only one side probes
    the other's list, it counts for both.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for batch in batches:
        for left, right, role, same in zip(batch["left"], batch["right"], batch["role"], batch["same"]):
            a, b = _Block(left, kind), _Block(right, kind)
            tables = quantiser.tables(a.units)
            pairs, twice = [(np.zeros(0, dtype=np.int64),) * 2], [np.zeros(0, dtype=bool)]
            for of in np.unique(b.lists):
                mine = np.flatnonzero(a.lists == of if role == 0 else a.probes(of))
                theirs = np.flatnonzero(b.lists == of)
                if not len(mine):
                    continue
                center = quantiser.centroids[of]
                shown, left_out, length = quantiser.encode(b.units[theirs] - center)
                apart = a.units[mine] - center
                squares = (tables[mine] - quantiser.tables(center[None])) @ (-2 * shown.T)
                near = squares <= ((reach + left_out) ** 2 - length)[None] - (apart**2).sum(axis=1)[:, None]
                if same:
                    near &= mine[:, None] < theirs[None]
                i, j = _exact(a.units[mine], b.units[theirs], near, threshold)
                pairs.append((mine[i], theirs[j]))
                home = a.lists[mine[i]]
                twice.append((b.probed[theirs[j], home >> 3] >> (home & 7)) & 1 == 1)
            i, j = (np.concatenate(x) for x in zip(*pairs))
            if not len(i):
                continue
            once = ~np.concatenate(twice)
            n = len(a.entries)
            entries = np.concatenate([a.entries, b.entries])
            links = np.concatenate([np.bincount(i, weights=b.copies[j], minlength=n), np.bincount(j[once], weights=a.copies[i[once]], minlength=len(b.entries))])
            root = forest(len(entries), i, j + n)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(entries))))
            yield pd.DataFrame({"entry": entries[some], "links": links[some].astype(np.int64), "root": entries[root[some]]})


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked if their cosine, in double precision, is at least ``threshold``, and only if they have the
    same dimension; null, empty or zero vectors and those with null or non-finite components have no links.
    ``component_id`` is the smallest id reachable (its own where nothing is linked), ``kept`` whether it is the
    row's own. Rows that repeat a vector are linked with each other, also where ids repeat. Null ids count as links
    of others and name no component. Other columns are ignored. An empty table gives an empty result.
    """
    spark = table.sparkSession
    small_batches(spark)
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col("vector")
    fine = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.array_join(F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x)), ",").cast("binary"), 256)))
    entries = rows.where("fine").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("vector").alias("vector"))
    entries = settle(entries.withColumn("entry", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    singles = settle(rows.select("id", "key"))
    found = None
    for width, n in sorted((r.width, r.n) for r in entries.groupBy("width").agg(F.count("*").alias("n")).collect()):
        part = _linked(entries.where(F.col("width") == width), n, threshold, single)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "entry long, links long, root long")
    small_batches(spark, BLOCKS_AT_ONCE)
    found = settle(found)
    small_batches(spark)
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("entry").alias("a"), F.col("root").alias("b")))
    rooted = entries.join(roots, entries["entry"] == roots["node"], "left").select("key", "entry", "copies", "least", F.coalesce("root", "entry").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(named, "root").join(links, "entry", "left")
    of = settle(of.select("key", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = singles.join(of, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _linked(entries: DataFrame, n: int, threshold: float, single: bool) -> DataFrame:
    """Links and forest (entry, links, root) among distinct vectors of one dimension."""
    spark = entries.sparkSession
    some = entries.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0) if n > 2 * SAMPLE else entries
    chosen = some.select("key", "vector").orderBy("key").limit(SAMPLE).toPandas()
    quantiser = Quantiser(_unit(np.stack(chosen["vector"].to_numpy())), n)
    kind = "<f4" if single else "<f8"

    @F.pandas_udf("binary")
    def raw(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=kind).tobytes() for v in vectors])

    parts = partitions(spark)
    rows = entries.select("entry", "copies", raw("vector").alias("vector")).mapInPandas(partial(_dealt, quantiser, threshold, kind), DEALT)
    dealt = rows.repartitionByRange(parts, "part", "role", "list", "entry").sortWithinPartitions("part", "role", "list", "entry")
    blocks = settle(dealt.mapInPandas(_packed, "part int, role int, low int, high int, least long, block binary"))
    salts = max(1, -(-2 * parts // len(np.unique(quantiser.groups))))
    right = blocks.where("role = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "low", F.col("least").alias("r"), F.col("block").alias("right"))
    salt = F.pmod(F.xxhash64("role", "low", "least"), F.lit(salts)).cast("int").alias("salt")
    left = blocks.select("part", salt, "role", "high", F.col("low").alias("from"), F.col("least").alias("l"), F.col("block").alias("left"))
    pairs = left.join(right, ["part", "salt"]).where((F.col("role") == 1) | (F.col("from") < F.col("low")) & (F.col("high") >= F.col("low")) | (F.col("from") == F.col("low")) & (F.col("l") <= F.col("r")))
    pairs = pairs.select("left", "right", "role", ((F.col("role") == 0) & (F.col("from") == F.col("low")) & (F.col("l") == F.col("r"))).alias("same"))
    return pairs.mapInPandas(partial(_compared, quantiser, threshold, kind), "entry long, links long, root long")

"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. The index has, from the top:

* families of upper nodes, each factoring out a masked pattern of bits that all fingerprints below it share;
* below each of them, the fingerprints in the order of their Gray rank, where neighbours share most of their bits;
* groups of FAN neighbours, of FAN groups and so on, each with the mask and pattern of the bits all members share.

The search descends pairs of groups, adds up the differences of what their masks share, and drops a pair of
whole groups once the sum exceeds the radius. Spark range-partitions and sorts the entries by (node, Gray rank);
each task streams through its part and grows the trees of all runs of a batch at once.

Two operators stand on it:

* ``near_duplicates`` links 64-bit fingerprints of three-word shingles within ``radius`` bits. Its nodes are
  ``radius + 1`` blocks of bits, of which two linked fingerprints share one, so no link is missed.
* ``similar`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that
  similarity 15 % of the bits differ, too many for blocks, so a node is a choice of bits out of ``WIDE`` words, in as
  many families as the wanted ``MISS`` asks for. What the tree leaves is compared by the sets themselves. Sets of up
  to SHORT shingles, whose bits scatter most, are linked without bits, through the shingles that they share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import connected_components, content_key, partitions, settle, small_batches, whole

CHUNK = 2048
FAN = 16
BATCH = 20_000
BLOCK_OF_SHINGLES = 255 * 32

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``words``, in blocks; fewer words than ``width`` are one shingle."""
    n = max(1, len(words) - width + 1)
    for start in range(0, n, BLOCK_OF_SHINGLES):
        stop = min(n, start + BLOCK_OF_SHINGLES)
        shingles = map(b" ".join, zip(*(words[start + k : stop + k] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter(map(_hash, shingles), dtype="<u8", count=stop - start)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of ``hashes`` (n, words)."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    by_255 = bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return by_255.sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.uint8)


def fingerprint_of(text: bytes | None, width: int = 3) -> int:
    """Fingerprint as a signed 64-bit integer; zero for null or wordless texts."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    ones = sum(_ones(h[:, None]) for h in _hashes(words, width))
    return int(np.packbits(2 * ones > max(1, len(words) - width + 1), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def gray_rank(bits: Column) -> Column:
    """Position of a code word in Gray order, shifted so that signed order is the unsigned order."""
    for by in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, by))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class _Trees:
    """The trees of several runs of codes in Gray order; level 0 has the codes, the last level one root a run."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray) -> None:
        self.masks, self.patterns = [np.full(len(codes), ~np.uint64(0))], [codes]
        self.first: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.ends: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        sizes = np.diff(np.r_[starts, len(codes)])
        while sizes.max(initial=0) > 1:
            groups = -(-sizes // FAN)
            at = np.repeat(_offsets(sizes), groups) + FAN * (np.arange(groups.sum()) - np.repeat(_offsets(groups), groups))
            every, some = np.bitwise_and.reduceat(self.patterns[-1], at), np.bitwise_or.reduceat(self.patterns[-1], at)
            shared = np.bitwise_and.reduceat(self.masks[-1], at) & ~(every ^ some)
            self.first.append(at)
            self.ends.append(np.r_[at[1:], len(self.patterns[-1])])
            self.masks.append(shared)
            self.patterns.append(every & shared)
            sizes = groups

    def raised(self, height: int) -> _Trees:
        """As high as ``height`` levels: nodes of one child on top."""
        while len(self.masks) < height:
            n = len(self.masks[-1])
            self.first.append(np.arange(n))
            self.ends.append(np.arange(n) + 1)
            self.masks.append(self.masks[-1])
            self.patterns.append(self.patterns[-1])
        return self


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of codes within ``radius``: i < j in one run of ``left`` (runs begin at ``starts``), or in ``left`` and ``right``."""
    a = _Trees(left, np.zeros(1, dtype=np.int64) if starts is None else starts)
    b = a if right is None else _Trees(right, np.zeros(1, dtype=np.int64))
    height = max(len(a.masks), len(b.masks))
    a.raised(height), b.raised(height)
    i = np.arange(len(a.masks[-1]))
    j = i.copy()
    counted, known = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.uint64)
    for level in range(height - 1, -1, -1):
        if right is None:
            keep = i < j if level == 0 else i <= j
            i, j, counted, known = i[keep], j[keep], counted[keep], known[keep]
        shared = a.masks[level][i] & b.masks[level][j]
        counted = counted + np.bitwise_count((a.patterns[level][i] ^ b.patterns[level][j]) & shared & ~known)
        keep = counted <= radius
        i, j, counted, known = i[keep], j[keep], counted[keep], shared[keep]
        if level:
            wide = b.ends[level][j] - b.first[level][j]
            sizes = (a.ends[level][i] - a.first[level][i]) * wide
            of = np.repeat(np.arange(len(i)), sizes)
            at = np.arange(len(of)) - np.repeat(_offsets(sizes), sizes)
            i, j = a.first[level][i][of] + at // wide[of], b.first[level][j][of] + at % wide[of]
            counted, known = counted[of], known[of]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _links(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = forest(len(codes), i, j)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    """Sorted rows (key, ...) as (open, starts of the runs of equal keys, columns).

    Runs that may go on elsewhere (in the next piece, in another task) come alone and are ``open``; so does every piece
    of a run that was cut. No piece of a run has more than CHUNK rows.
    """
    held = [np.zeros(0, dtype=np.int64) for _ in columns]
    first: int | None = None
    cut: int | None = None

    def pieces(rows: list[np.ndarray]) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
        for at in range(0, len(rows[0]), CHUNK):
            yield True, np.zeros(1, dtype=np.int64), [c[at : at + CHUNK] for c in rows]

    for batch in batches:
        rows = [np.concatenate([h, batch[c].to_numpy(np.int64)]) for h, c in zip(held, columns)]
        if not len(rows[0]):
            continue
        keys = rows[0]
        first = int(keys[0]) if first is None else first
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        alone = (sizes > CHUNK) | (keys[starts] == first)
        if cut is not None:
            alone |= keys[starts] == cut
        alone[-1] = False
        for s, n in zip(starts[alone], sizes[alone]):
            yield from pieces([c[s : s + n] for c in rows])
        rest = ~alone
        rest[-1] = False
        if rest.any():
            some = np.repeat(rest, sizes)
            yield False, _offsets(sizes[rest]), [c[some] for c in rows]
        last, n = starts[-1], sizes[-1] // CHUNK * CHUNK
        if n:
            cut = int(keys[last])
            yield from pieces([c[last : last + n] for c in rows])
        held = [c[last + n :] for c in rows]
    if len(held[0]):
        yield from pieces(held)


SEARCH_SCHEMA = "a long, b long, key long, chunk long, mask long, pattern long, codes binary"
COLUMNS = [c.split()[0] for c in SEARCH_SCHEMA.split(", ")]


def _search(radius: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside each run; the runs that may go on elsewhere also leave as chunks."""
    part, chunk = TaskContext.get().partitionId(), 0
    for open_, starts, (keys, signed) in _runs(batches, ["key", "code"]):
        codes = signed.view(np.uint64)
        a, b = _links(codes, *close_pairs(codes, None, radius, starts))
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).reindex(columns=COLUMNS)
        if open_:
            chunk += 1
            every, some = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
            mask = ~(every ^ some)
            row = {"key": [int(keys[0])], "chunk": [(part << 32) | chunk], "mask": [int(mask.view(np.int64))], "pattern": [int((every & mask).view(np.int64))], "codes": [codes.tobytes()]}
            yield pd.DataFrame(row).reindex(columns=COLUMNS)


def _across(radius: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for left, right in zip(batch["left"], batch["right"]):
            a, b = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            i, j = close_pairs(a, b, radius)
            x, y = _links(np.concatenate([a, b]), i, j + len(a))
            yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})


def links(codes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly the distinct ``codes`` (code long) within ``radius`` bits of each other.

    Only a spanning forest of every chunk's links leaves a task, never all pairs of a dense group. Runs cut by a chunk
    or a partition border meet again as pairs of chunks, pruned by their masks before any entry is compared.
    """
    blocks = radius + 1
    width = 64 // blocks
    nodes = F.array(*(F.shiftrightunsigned("code", k * width).bitwiseAND((1 << width) - 1) + F.lit(k << width) for k in range(blocks)))
    entries = codes.select("code", F.explode(nodes).alias("key"), gray_rank(F.col("code")).alias("rank"))
    small_batches(codes.sparkSession, BATCH)
    found = settle(
        entries.repartitionByRange(partitions(codes.sparkSession), "key", "rank").sortWithinPartitions("key", "rank").select("key", "code").mapInPandas(partial(_search, radius), SEARCH_SCHEMA)
    )
    small_batches(codes.sparkSession)
    chunks = found.where("key is not null").select("key", "chunk", "mask", "pattern", "codes")
    left, right = (chunks.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("chunk", "mask", "pattern", "codes"))) for side in ("l", "r"))
    apart = F.bit_count(F.expr("(l_pattern ^ r_pattern) & l_mask & r_mask"))
    across = (
        left.join(right, "key")
        .where((F.col("l_chunk") < F.col("r_chunk")) & (apart <= radius))
        .select(F.col("l_codes").alias("left"), F.col("r_codes").alias("right"))
        .mapInPandas(partial(_across, radius), "a long, b long")
    )
    return found.where("a is not null").select("a", "b").unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``text_key``, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links, itself included; null ids never name a component
    unless it has no other. Null, empty and wordless texts have fingerprint zero and are linked like any other.
    Repeated rows keep their rows. Columns other than the two named ones are ignored. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    prints = settle(
        docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("text_key"), _fingerprints(F.col(text_col).cast("binary")).alias("code"))
    )
    codes = prints.groupBy("code").agg(F.min("id").alias("least"))
    of = _named(codes, "code", connected_components(links(codes.select("code"), radius)))
    return prints.join(of, "code").select(F.col("id").alias(id_col), "text_key", F.col("code").alias("fingerprint"), "component_id")


def _named(entries: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id): the smallest ``least`` of each component of ``entries``."""
    rooted = entries.join(roots, entries[key] == roots["node"], "left").select(key, "least", F.coalesce("root", key).alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return settle(rooted.join(component, "root").select(key, "component_id"))


WIDTH = 5
SIMILARITY = 0.8
WIDE = 8
FINE = 64
MISS = 0.01
RUN = 128
PAIRS_A_ENTRY = 1
CENTRES = 3


SHORT = 15


def least_shared(a: int, b: int) -> int:
    """The fewest shingles that sets of ``a`` and ``b`` have in common at SIMILARITY."""
    return math.ceil(SIMILARITY * (a + b) / (1 + SIMILARITY) - 1e-9)


def left_out(n: int) -> int:
    """How many shingles of a set of ``n`` a similar one of SHORT shingles at most can lack."""
    return max(n - least_shared(m, n) for m in range(1, SHORT + 1) if least_shared(m, n) <= min(m, n))


def differing_of(a: int, b: int, both: int) -> float:
    """The share of bits that differ, on average, between sets of ``a`` and ``b`` shingles with ``both`` in common."""
    common, left, right = ([math.comb(n, k) / 2.0**n for k in range(n + 1)] for n in (both, a - both, b - both))
    out = 0.0
    for k, p in enumerate(common):
        x = sum(q for u, q in enumerate(left) if 2 * (k + u) > a)
        y = sum(q for v, q in enumerate(right) if 2 * (k + v) > b)
        out += p * (x * (1 - y) + y * (1 - x))
    return out


def arc(similarity: float) -> float:
    """The share of bits that differ, on average, between two long sets of equal size at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@lru_cache
def differing(similarity: float) -> float:
    """The largest share of bits that differ, on average, between two sets at a Jaccard similarity of which one is larger
    than SHORT: for long sets that of ``arc``, for those just above SHORT what counting their bits gives."""
    out = arc(similarity)
    for b in range(SHORT + 1, 6 * SHORT):
        for a in range(math.ceil(similarity * b - 1e-9), b + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both <= a:
                out = max(out, differing_of(a, b, both))
    return out


def radius_for(share: float, miss: float, bits: int = 64) -> int:
    """The fewest differing bits that all but ``miss`` of the pairs keep to of which a ``share`` of the bits differ."""
    p, sure = share, 0.0
    for r in range(bits + 1):
        sure += math.exp(math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1) + r * math.log(p) + (bits - r) * math.log(1 - p))
        if 1 - sure <= miss:
            return r
    return bits


def unseen(share: float, taken: int, families: int) -> float:
    """The probability that two fingerprints, of which a ``share`` of the bits differ, agree on no family of ``taken`` bits."""
    bits, out = 64 * (WIDE - 1), 0.0
    for d in range(bits + 1):
        log = math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(share) + (bits - d) * math.log(1 - share)
        agree = math.prod((bits - d - k) / (bits - k) for k in range(taken)) if bits - d >= taken else 0.0
        out += math.exp(log) * (1 - agree) ** families
    return out


def families(entries: int, similarity: float, miss: float) -> list[list[int]]:
    """The bits of each family of nodes: as many bits as leave about RUN unrelated entries in a node, and as many
    families as find a pair at ``similarity`` in all but ``miss`` cases. Bits come from the words after the first."""
    taken, n = max(4, math.ceil(math.log2(max(1, entries) / RUN))), 1
    while unseen(differing(similarity), taken, n) > miss:
        n += max(1, n // 16)
    rng = np.random.default_rng(1031)
    return [sorted(rng.choice(np.arange(64, 64 * WIDE), size=taken, replace=False).tolist()) for _ in range(n)]


_FACTORS = np.random.default_rng(811).integers(0, 1 << 63, size=FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles (words in lower case); none for null or wordless texts."""
    words = (text.decode(errors="replace") if isinstance(text, bytes) else text or "").lower().encode().split()
    return np.unique(np.concatenate(list(_hashes(words, WIDTH)))) if words else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(found: np.ndarray, words: int = WIDE) -> np.ndarray:
    """So many words of the bitwise majority over a shingle set."""
    ones, step = np.zeros(64 * words, dtype=np.int64), BLOCK_OF_SHINGLES * WIDE // words
    for at in range(0, len(found), step):
        mixed = found[at : at + step, None] * _FACTORS[:words]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += _ones(np.ascontiguousarray(mixed ^ (mixed >> np.uint64(29))))
    return np.packbits(2 * ones > len(found), bitorder="little").view("<i8")


@F.pandas_udf(T.StructType().add("content", T.BinaryType()).add("size", T.IntegerType()).add("short", T.ArrayType(T.LongType())).add("code", T.ArrayType(T.LongType())))
def _sketched(texts: pd.Series) -> pd.DataFrame:
    """A set's hash, its size, the set itself if it is short, and its fingerprint."""
    sets = [shingle_set(t) for t in texts]
    short = [x.view(np.int64).tolist() if len(x) <= SHORT else None for x in sets]
    return pd.DataFrame({"content": [xxhash.xxh128_digest(x.tobytes()) for x in sets], "size": [len(x) for x in sets], "short": short, "code": [wide_fingerprint(x).tolist() for x in sets]})


@F.pandas_udf(T.ArrayType(T.StructType().add("shared", T.IntegerType()).add("s", T.LongType()).add("t", T.LongType())))
def _parts(sets: pd.Series) -> pd.Series:
    """What of each set a similar one can share with it: the sizes and two sums of mixed hashes of all parts that lack few enough."""
    out = []
    for found in sets:
        x = np.asarray(found, dtype=np.int64).view(np.uint64)
        mixed = [(x ^ (x >> np.uint64(29))) * f for f in _FACTORS[:2]]
        mixed = [(m ^ (m >> np.uint64(32))).view(np.int64) for m in mixed]
        rows = []
        for lacks in range(left_out(len(x)) + 1 if len(x) else 0):
            some = np.array(list(combinations(range(len(x)), lacks)), dtype=np.int64).reshape(math.comb(len(x), lacks), lacks)
            sums = [(m.sum() - m[some].sum(axis=1)).tolist() for m in mixed]
            rows += [{"shared": len(x) - lacks, "s": s, "t": t} for s, t in zip(*sums)]
        out.append(rows)
    return pd.Series(out, dtype=object)


def _short_links(entries: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly those entries of at most SHORT shingles that are similar.

    Two similar sets both have the part that they share, so they meet under it. Of all sets that have a part, the smallest
    is similar to every one that is similar to any of them, by this part alone: links with it are enough.
    """
    parts = settle(entries.where("short is not null").select("entry", "size", F.explode(_parts("short")).alias("p")).select("entry", "size", "p.*"))
    least = parts.groupBy("s", "t").agg(F.min(F.struct("size", "entry")).alias("least"), F.count("*").alias("n")).where("n > 1").select("s", "t", "least")
    met = parts.join(least, ["s", "t"]).where(F.col("entry") != F.col("least.entry"))
    alike = F.col("shared") >= SIMILARITY * (F.col("size") + F.col("least.size") - F.col("shared")) - 1e-9
    return settle(met.where(alike).select(F.col("least.entry").alias("a"), F.col("entry").alias("b")).distinct())


@F.pandas_udf(T.BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _fine(sets: pd.Series) -> pd.Series:
    return pd.Series([wide_fingerprint(np.frombuffer(x, dtype=np.uint64), FINE) for x in sets])


@F.pandas_udf(T.BooleanType())
def _alike(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a: bytes, b: bytes) -> bool:
        if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-6:
            return False
        x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=bool)


NODE_SCHEMA = "a long, b long, key long, entry long, middle boolean"


def _nodes(bits: list[list[int]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each entry and family: the node's key, and the first two words of the fingerprint."""
    for batch in batches:
        if not len(batch):
            continue
        words = np.stack(batch["code"].to_numpy()).astype("<i8")
        spread = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
        for k, own in enumerate(bits):
            pattern = np.zeros(len(words), dtype=np.int64)
            for bit in own:
                pattern = (pattern << 1) | spread[:, bit]
            # 20 bits say the family; a pattern of more than 43 bits, beyond 10^14 entries, would share nodes, which only costs time
            yield pd.DataFrame({"key": (pattern & ((1 << 43) - 1)) | (k << 43), "entry": batch["entry"].to_numpy(), "code": words[:, 0], "second": words[:, 1]})


def _middle(words: np.ndarray) -> np.ndarray:
    """Positions of the rows of ``words`` (n, 2), those closest to the bitwise majority of all first."""
    ones = _ones(words)
    majority = np.packbits(2 * ones > len(words), bitorder="little").view("<u8")
    return np.argsort(np.bitwise_count(words ^ majority).sum(axis=1), kind="stable")


def _candidates(radius: int, both: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of entries to compare, within ``radius`` bits of the first word and ``both`` of two words.

    Where a group of a node has more than PAIRS_A_ENTRY close pairs for each entry, its entries leave under a key of the
    group, each in one row with its pair: with the first that is close of CENTRES entries in the middle of the group (of many
    copies of a text, the text itself). So do all entries of a node that is cut, under the node's key. No more than
    1 + PAIRS_A_ENTRY rows leave for each row that comes, however many entries a group has.
    """
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def paired(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates().reindex(columns=columns)

    for open_, starts, (keys, entries, signed, more) in _runs(batches, ["key", "entry", "code", "second"]):
        words = np.stack([signed, more], axis=1).view(np.uint64)
        i, j = close_pairs(words[:, 0].copy(), None, radius, starts)
        keep = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= both
        i, j = i[keep], j[keep]
        group = forest(len(keys), i, j)
        sizes = np.bincount(group, minlength=len(keys))
        dense = np.bincount(group[i], minlength=len(keys)) > PAIRS_A_ENTRY * sizes
        few = ~dense[group[i]]
        yield paired(entries[i[few]], entries[j[few]])
        middle, centre = np.zeros(len(keys), dtype=bool), np.full(len(keys), -1)
        order = np.argsort(group, kind="stable")
        for g in np.flatnonzero(dense):
            at = np.searchsorted(group[order], g)
            own = order[at : at + sizes[g]]
            for c in own[_middle(words[own])[:CENTRES]]:
                near = own[(np.bitwise_count(words[own] ^ words[c]).sum(axis=1) <= both) & (centre[own] < 0)]
                centre[near[near != c]] = c
        if open_:
            largest = order[np.searchsorted(group[order], sizes.argmax()) :][: sizes.max()]
            middle[largest[_middle(words[largest])[:1]]] = True
        some = np.full(len(keys), True) if open_ else dense[group]
        of = keys if open_ else (keys.view(np.uint64) * _FACTORS[0] + entries[group].view(np.uint64) * _FACTORS[1]).view(np.int64)
        if some.any():
            x, y, alone = entries[some], entries[centre[some]], centre[some] < 0
            a, b = (pd.arrays.IntegerArray(side(x, y), alone) for side in (np.minimum, np.maximum))
            yield pd.DataFrame({"a": a, "b": b, "key": of[some], "entry": x, "middle": middle[some]})


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _differing(code: str, other: str, words: int) -> Column:
    return sum((F.bit_count(F.col(code)[k].bitwiseXOR(F.col(other)[k])) for k in range(words)), F.lit(0))


def _sets_of(met: DataFrame, entries: DataFrame, rows: DataFrame) -> DataFrame:
    """The shingle sets of all entries in ``met``, each from one document."""
    wanted = entries.join(met, "entry", "left_semi").select("entry", F.col("of.text_key").alias("of_key"), F.col("of.id").alias("of_id"))
    texts = rows.join(wanted, (F.col("text_key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id")))
    sets = settle(texts.select("entry", _sets("text").alias("shingles")))
    repeated = sets.groupBy("entry").count().where("count > 1")
    return sets if repeated.isEmpty() else settle(sets.dropDuplicates(["entry"]))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among ``pairs``, by the sets themselves."""
    right = pairs.join(sets.select(F.col("entry").alias("b"), F.col("shingles").alias("y")), "b")
    both = right.join(sets.select(F.col("entry").alias("a"), F.col("shingles").alias("x")), "a")
    return settle(both.where(_alike("x", "y")).select("a", "b"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """One row per document: ``id_col``, ``text_key`` and ``component_id``, the smallest id reachable over links.

    Texts are linked if the Jaccard similarity of their five-word shingle sets is 0.8 or more; what is linked is exact.
    Between sets of at most SHORT shingles no link is missed; beyond, a pair at exactly 0.8 stays unseen with the
    probability ``miss`` at most, one above it less and less. Texts with
    equal sets are one entry. Null ids never name a component unless it has no other. Null, empty and wordless texts
    are linked with each other. Repeated rows keep their rows. Columns other than the two named ones are ignored. An
    empty table gives an empty result.

    Where very many entries of a node are close, all their pairs are not written out. They are compared with those in
    their middle first; later every pair follows whose entries are still in different components.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    prints = settle(rows.select("id", "text_key", _sketched("text").alias("s")).select("id", "text_key", "s.*"))
    same = (F.first(c).alias(c) for c in ("size", "short", "code"))
    entries = prints.groupBy("content").agg(F.min("id").alias("least"), F.min(F.struct("text_key", "id")).alias("of"), *same)
    entries = settle(entries.withColumn("entry", F.monotonically_increasing_id()))
    short = _short_links(entries)
    # smaller sets are similar to none but short ones
    long = entries.where(F.col("size") >= math.ceil(SIMILARITY * (SHORT + 1) - 1e-9))
    bits = families(long.count(), SIMILARITY, miss / 2)
    # few bits say little anyway, so the longest sets set their bounds; where many are counted, those that scatter most do
    radius, both = (radius_for(arc(SIMILARITY), miss / 8, 64 * n) for n in (1, 2))
    wide, finest = (radius_for(differing(SIMILARITY), miss / 8, 64 * n) for n in (WIDE, FINE))
    nodes = long.select("entry", "code").mapInPandas(partial(_nodes, bits), "key long, entry long, code long, second long")
    order = ("key", gray_rank(F.col("code")))
    small_batches(spark, BATCH)
    found = settle(nodes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInPandas(partial(_candidates, radius, both), NODE_SCHEMA))
    small_batches(spark)
    dense = settle(found.where("key is not null").select("key", "entry").join(entries.select("entry", "code"), "entry"))
    middle = found.where("middle").select("key", F.col("entry").alias("x")).groupBy("key").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    centre = middle.join(entries.select(F.col("entry").alias("x"), F.col("code").alias("code_x")), "x")
    around = dense.join(centre, "key").where(_differing("code", "code_x", WIDE) <= wide).select("x", F.col("entry").alias("y"))
    first = settle(_pairs(found.where("a is not null").select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(around)))
    met = first.select(F.col("a").alias("entry")).unionByName(first.select(F.col("b").alias("entry"))).unionByName(dense.select("entry"))
    sets = _sets_of(met.distinct(), entries, rows)
    roots = connected_components(_checked(first, sets).unionByName(short))

    named = dense.join(roots, dense["entry"] == roots["node"], "left").select("key", "entry", "code", F.coalesce("root", "entry").alias("root"))
    shares = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = shares.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("main.root").alias("main"))
    fine = sets.join(dense.select("entry").distinct(), "entry", "left_semi").select("entry", _fine("shingles").alias("fine"))
    named = settle(named.join(main, "key").join(fine, "entry"))
    other = named.where("root != main").select("key", *(F.col(c).alias(f"{c}_x") for c in ("entry", "code", "fine", "root")))
    apart = named.join(other, "key").where((F.col("root") != F.col("root_x")) & ((F.col("root") == F.col("main")) | (F.col("entry") < F.col("entry_x"))))
    apart = apart.where((_differing("code", "code_x", WIDE) <= wide) & (_differing("fine", "fine_x", FINE) <= finest))
    rest = settle(_pairs(apart.select(F.col("entry_x").alias("x"), F.col("entry").alias("y"))).join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        late = _checked(rest, sets)
        for side in ("a", "b"):
            late = late.join(roots, late[side] == roots["node"], "left").withColumn(side, F.coalesce("root", side)).drop("node", "root")
        merged = connected_components(late).select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = old.unionByName(merged.select(F.col("root").alias("node"), F.col("top").alias("root")))
    of = _named(entries.select("content", "least", "entry"), "entry", roots)
    of = entries.select("entry", "content").join(of, "entry").select("content", "component_id")
    return prints.join(of, "content").select(F.col("id").alias(id_col), "text_key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The documents of which one per component stays: the one with the smallest id (then the smallest text key).

    All columns of ``docs`` are kept, whatever their names. Of rows that repeat both id and text, one stays.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``keep_one``, for the components of ``similar``."""
    return keep_least(docs, similar(docs, id_col, text_col), id_col, text_col)


def keep_least(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component in ``rows``, the document with the smallest id (then the smallest text key)."""
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_key").alias("t"))
    chosen = settle(rows.groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k.i").alias("chosen_id"), F.col("k.t").alias("chosen_key")))
    keyed = docs.select(whole(docs), F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("text_key"))
    kept = keyed.join(chosen, (F.col("text_key") == F.col("chosen_key")) & F.col("id").eqNullSafe(F.col("chosen_id")), "left_semi")
    return kept.dropDuplicates(["id", "text_key"]).select("doc.*")

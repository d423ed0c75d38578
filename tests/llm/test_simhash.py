import math
import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import simhash
from millrace.llm.catalog import op1_simhash

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: id -> fingerprint; id -> smallest reachable id."""
    least = {}
    for i, p in prints.items():
        least[p] = min(i, least.get(p, i))
    values = list(least)
    seen, out = set(), {}
    for v in values:
        if v in seen:
            continue
        group, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for y in values:
                if y not in group and (x ^ y).bit_count() <= 3:
                    group.add(y)
                    todo.append(y)
        seen |= group
        out |= dict.fromkeys(group, min(least[g] for g in group))
    return {i: out[p] for i, p in prints.items()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    parts = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_dense_and_random_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = __import__("random").Random(7)
    center = rng.getrandbits(64)
    codes = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(900)} | {0, (1 << 64) - 1}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"))
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    got = {c: roots.get(c, c) for c in signed}
    ids = dict(enumerate(sorted(codes)))
    want = plain_components(ids)
    groups_got, groups_want = {}, {}
    for i, c in ids.items():
        groups_got.setdefault(got[c - (1 << 64) if c >> 63 else c], set()).add(i)
        groups_want.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


def test_edge_cases(spark):
    rows = [(1, "a b c d", 9), (1, "a b c d", 9), (2, "A  b\tc d", 9), (None, "a b c d", 9), (3, None, 9), (4, "", 9), (5, " \n", None), (6, "x", 9), (7, "x " * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = simhash.near_duplicates(docs).orderBy("doc_id", "text_key").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (None, 1, 2, 3, 4, 5)} == {(None, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def plain_shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike_components(texts):
    """texts: id -> text; id -> smallest id reachable over exact similarity."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j:
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if not either or 10 * both >= 8 * either:
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def edited_documents():
    """Copies with a few words edited, about half of them above the limit, and a dense group."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(40, 200))
        texts.append(base)
        for _ in range(3):
            copy, edits = list(base), rng.randint(1, 1 + len(base) // 25)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    base = rng.choices(vocabulary, k=120)
    texts += [[w if i != at and i != at + 40 else "x" for i, w in enumerate(base)] for at in range(60)]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)} | {1000: "", 1001: " ", 1002: "one two", 1003: "One  two"}


def test_stage_equals_brute_force_similarity(spark):
    texts = edited_documents()
    want = alike_components(texts)
    assert 30 < len(set(want.values())) < len(texts) - 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == want
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_table_equals_brute_force_similarity(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = alike_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want


def test_edge_cases_of_similar(spark):
    rows = [(1, "a b c d", 9), (1, "a b c d", 9), (2, "A  b\tc d", 9), (None, "a b c d", 9), (3, None, 9), (4, "", 9), (6, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entry int")
    got = simhash.similar(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(None, 1), (1, 1), (2, 1), (3, 3), (4, 3), (6, 6)}
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect()) == [1, 3, 6]
    assert simhash.similar(docs.limit(0)).count() == 0


def components(docs):
    """Smallest id reachable over pairs of five-word shingle sets at a similarity of 0.8, by comparing all."""
    sets = {}
    for i, text in docs:
        words = text.split()
        sets[i] = frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if 10 * len(x & y) >= 8 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def found_components(spark, docs):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_short_texts_in_dense_groups(spark):
    """Stars whose copies are similar to their middle only, at exactly 0.8 or above, and chains of short texts."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), size=9))
    docs = []
    for base, more, n in ((8, 1, 60), (10, 1, 40), (12, 2, 40), (14, 3, 20), (5, 0, 3), (19, 3, 30)):
        middle = [word() for _ in range(base)]
        docs += [" ".join(middle)] + [" ".join(middle + [word() for _ in range(more)]) for _ in range(n)]
    chain = [word() for _ in range(30)]
    docs += [" ".join(chain[k : k + size]) for size in (5, 6, 9, 10, 13, 14, 18, 19) for k in range(0, 11)]
    docs = [(int(k), t) for k, t in enumerate(rng.permutation(docs).tolist())]
    assert found_components(spark, docs) == components(docs)


def test_every_split_of_short_sets_is_met():
    """Any two sets of which none is larger than SHORT and that are similar share a part that both give."""
    for a in range(1, simhash.SHORT + 1):
        for b in range(a, simhash.SHORT + 1):
            both = simhash.least_shared(a, b)
            if both <= a:
                assert 10 * both >= 8 * (a + b - both) and 10 * (both - 1) < 8 * (a + b - both + 1)
                assert a - both <= simhash.left_out(a) and b - both <= simhash.left_out(b)
    # and no set that is left to this path alone is similar to one beyond it
    longest = math.ceil(simhash.SIMILARITY * (simhash.SHORT + 1) - 1e-9) - 1
    assert all(simhash.least_shared(a, b) > a for a in range(1, longest + 1) for b in range(simhash.SHORT + 1, 60))


def test_rows_of_candidates_grow_with_the_entries_only():
    """A dense group of near copies gives a row for each of its entries, and each is paired with one in the middle."""
    rng = np.random.default_rng(3)
    text, noise = rng.integers(0, 1 << 63, size=2, dtype=np.uint64), rng.integers(0, 1 << 63, size=(40, 2), dtype=np.uint64)
    for m in (500, 1000, 2000, 5000):
        flips = np.packbits(rng.random((m, 128)) < 0.04, axis=1).view(np.uint64)
        words = np.concatenate([noise[:20], text ^ flips, noise[20:]]).view(np.int64)
        rows = pd.DataFrame({"key": np.repeat([1, 2, 3], [20, m, 20]), "entry": (1 << 60) + np.arange(len(words)), "code": words[:, 0], "second": words[:, 1]})
        frames = list(simhash._candidates(19, 32, iter([rows])))
        made = pd.concat([f.astype("object") for f in frames])
        assert len(made) <= (1 + simhash.PAIRS_A_ENTRY) * len(rows)
        group, pairs = set(rows["entry"][20 : 20 + m]), made.dropna(subset=["a"])
        assert set(pairs["a"]) | set(pairs["b"]) == group == set(made["entry"][made["entry"].isin(group)])
        assert all(e in (a, b) and a < b for a, b, e in zip(pairs["a"], pairs["b"], pairs["entry"]))


def test_large_dense_groups_equal_brute_force(spark, monkeypatch):
    """Copies of a text that are similar to it and not to each other, copies of copies and texts that share a template, in nodes that are cut too."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    docs = []
    for length, edits, n in ((60, 1, 120), (120, 2, 120), (150, 6, 150)):
        base = [word() for _ in range(length)]
        docs.append(" ".join(base))
        for _ in range(n):
            copy = list(base)
            for at in rng.sample(range(length), edits):
                copy[at] = word()
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want = components(docs)
    assert 20 < len(set(want.values())) < len(docs) - 200
    assert found_components(spark, docs) == want
    monkeypatch.setattr(simhash, "CHUNK", 32)
    assert found_components(spark, docs) == want

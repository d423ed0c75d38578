import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import spelling
from millrace.llm.catalog import op12_spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_words(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain(words):
    """Each word against each other, by length."""
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = rows(op12_spelling(spark, "/root/testdata/sf0.001"))
    assert got == plain(plain_words(map(tuple, docs)))
    assert sum(r[4] for r in got) > 100


def variants_of(rng, letters, n):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(list(letters), size=int(rng.integers(3, 9))))
        words[w] = int(rng.choice([1, 2, 5, 10, 60, 1000, 20_000]))
        for _ in range(3):
            at, c = int(rng.integers(len(w))), str(rng.choice(list(letters)))
            words.setdefault([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]][int(rng.integers(3))], int(rng.integers(1, 30)))
    return words


@pytest.mark.parametrize("node, pairs", [(30_000, 400_000), (40, 50), (1, 3)])
def test_dense_words_in_nodes_of_any_size(spark, monkeypatch, node, pairs):
    """Few letters, so that leaves hold many words and each has many near ones."""
    monkeypatch.setattr(spelling, "NODE", node)
    words = variants_of(np.random.default_rng(3), "abeté×", 400)
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words)
    letters, trie = spelling.Letters(list(words)), spelling._Trie(np.array([spelling.path_of(w) for w in words]))
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    x, y = (np.concatenate(side) for side in zip(*spelling.near_paths(trie, None, 1, 1)))
    assert len(set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))) == len(x)
    assert 2 * int(letters.one_edit(x, y).sum()) == sum(r[4] for r in got)


def test_each_pair_of_upper_nodes_is_asked_once():
    rng = np.random.default_rng(1)
    paths = np.unique(rng.integers(0, 3, size=(60, 4)), axis=0)
    numbers = (paths.astype(np.uint64) @ spelling._WEIGHTS[:4]).tolist()
    asked = Counter((numbers[i], int(node)) for rows, nodes, _, _ in spelling.reached(paths) for i, node in zip(rows, nodes))
    for p, a in zip(paths.tolist(), numbers):
        for q, b in zip(paths.tolist(), numbers):
            more = sum(max(x - y, 0) for x, y in zip(p, q)), sum(max(y - x, 0) for x, y in zip(p, q))
            if p < q:
                assert asked[a, b] + asked[b, a] == (max(more) <= 1)


def test_words_of_texts(spark):
    docs = [(1, None), (2, ""), (3, "Elephant ELEPHANT élephant"), (3, "Elephant ELEPHANT élephant"), (None, "elephant×x elephants"), (4, "x" * 50_000), (5, "x" * 50_000), (6, "short words only")]
    got = dict(map(tuple, spelling.noisy_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == plain_words(docs)
    assert rows(spelling.variants(spelling.noisy_words(spark.createDataFrame(docs, "doc_id long, text string")))) == plain(got)


def test_chains_nulls_empty_and_clashing_columns(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 10**9, "": 7, "a": 70}
    df = spark.createDataFrame([(w, n, 1, 2) for w, n in words.items()] + [(None, 4, 1, 2)], "word string, n long, path int, form int")
    got = {r["word"]: r for r in spelling.variants(df).collect()}
    assert got["abcdefg"]["root"] == "abcdefghij" and got["abcdefg"]["form"] == "abcdefgh"
    assert got[None]["n_near"] == 0 and got[None]["root"] is None
    assert got[""]["form"] == "a" and got["a"]["form"] is None
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.noisy_words(spark.createDataFrame([], "doc_id long, text string, word string")).count() == 0

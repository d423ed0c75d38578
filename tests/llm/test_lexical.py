import math
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical
from millrace.llm.catalog import OP11_SQL, op11_lexical
from tests.oracle import assert_same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """Every document's score for every item, straight from the definition."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score:
                scores.append((-score, i is None, i if i is not None else 0, i))
        rows += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(d, b, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_agrees_with_sql(spark, folder):
    assert_same(spark, folder, op11_lexical, OP11_SQL)


def _made(n=300):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(60)] + ["Éa", "ü9", "X"])
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, size=int(rng.integers(1, 80)), p=p / p.sum()))) for i in range(n)]
    items = [(i, "-".join(rng.choice(words, size=int(rng.integers(1, 25))))) for i in range(25)]
    return docs, items


def test_equals_the_definition_with_ties_repeats_and_nulls(spark):
    docs, items = _made()
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (2000, None), (2001, ""), (2002, " ,;!")]
    docs.append((2003, "w1 " * 30_000 + "w2"))
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "w1 W1 w1"), (94, docs[7][1])]
    assert found(spark, docs, items) == plain(docs, items)


def test_small_blocks_and_groups_change_nothing(spark, monkeypatch):
    docs, items = _made()
    want = plain(docs, items, 3)
    monkeypatch.setattr(lexical, "VOCABULARY", 20)
    assert found(spark, docs, items, 3) == want


def test_bounds_of_pairs_are_safe_and_tighter_than_those_of_terms():
    docs, items = _made(2000)
    names = {t: k for k, t in enumerate(sorted({t for _, text in docs for t in terms(text)}))}
    rows = [(d, names[t], 1000 * n // (n + len(c))) for d, (_, text) in enumerate(docs) for c in [Counter(terms(text))] for t, n in c.items()]
    at, of, impact = (np.array(x, dtype=np.int64) for x in zip(*rows))
    block = lexical.Block(len(docs), of, at, impact)
    tighter = 0
    for _, text in items:
        query = np.array(sorted({names[t] for t in terms(text) if t in names}), dtype=np.int64)
        order, left, reached = block.ordered(query, 10)
        scores = np.zeros(len(docs), dtype=np.int64)
        for k in range(len(order) - 1, -1, -1):
            scores[block.docs[block.at[order[k]]]] += block.impacts[block.at[order[k]]]
            assert scores.max() <= left[k] <= sum(block.most[t] for t in order[k:])
            tighter += left[k] < sum(block.most[t] for t in order[k:])
        kth = np.sort(scores)[-10]
        assert reached <= kth
        hits, got = block.best(query, 10)
        assert sorted(np.flatnonzero(scores >= max(kth, 1))) == sorted(hits[got >= max(kth, 1)])
        assert (scores[hits] == got).all() and (block._dense == 0).all()
    assert tighter > 50


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "b c", 5, 6, 7)], "doc_id long, text string, score int, rank int, terms int")
    items = spark.createDataFrame([(1, "b a", 3, 4)], "item_id long, text string, doc int, query int")
    assert {tuple(r)[:3] for r in lexical.search(docs, items).collect()} == {(1, 1, 1), (1, 2, 2)}
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_invalid_utf8_and_names_of_other_types(spark):
    docs = spark.createDataFrame([("x", bytearray(b"\xff\xfe one")), ("y", bytearray(b"one two"))], "name string, body binary")
    items = spark.createDataFrame([("q", "two"), ("r", "one")], "item_id string, text string")
    got = {(r["item_id"], r["rank"], r["name"]) for r in lexical.search(docs, items, id_col="name", text_col="body").collect()}
    assert got >= {("q", 1, "y")} and {g[0] for g in got} == {"q", "r"}

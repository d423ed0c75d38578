import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from millrace.llm import langid as d
from millrace.llm.catalog import op2_langid


def plain_bits(counts, text, order=4):
    """Code length of ``text`` by a plain walk down the contexts; counts[k][context][byte]."""
    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            followers = counts[k].get(text[i - k : i])
            if not followers:
                continue
            n, u = sum(followers.values()), len(followers)
            if text[i] in followers:
                total -= math.log2(followers[text[i]] / (n + u))
                break
            total -= math.log2(u / (n + u))
        else:
            total += 8
    return total


def test_code_lengths_equal_a_plain_walk(monkeypatch):
    texts = {"aa": [b"the cat sat on the mat", b"that hat"], "bb": [b"le chat sur le tapis", b"ch\xc3\xa2teau"]}
    rows, plain = [], {}
    for lang, some in texts.items():
        counts = [defaultdict(Counter) for _ in range(5)]
        for t in some:
            for i in range(len(t)):
                for k in range(min(4, i) + 1):
                    counts[k][t[i - k : i]][t[i]] += 1
        plain[lang] = counts
        for k in range(5):
            for context, followers in counts[k].items():
                rows += [(lang, k, int.from_bytes(context + bytes([b]), "big"), n) for b, n in followers.items()]
    trees = d.Trees(pd.DataFrame(rows, columns=["lang", "k", "gram", "n"]))
    samples = [b"the hat", b"chat", b"zzz", b"", b"x", b"le tapis that sat", b"\xff\xfe", b"the cat " * 40]
    want = np.array([[plain_bits(plain[lang], s) for lang in ("aa", "bb")] for s in samples])
    assert np.allclose(trees.lengths(samples), want, rtol=1e-5)
    monkeypatch.setattr(d, "SLICE", 16)
    assert np.allclose(trees.lengths(samples), want, rtol=1e-5)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op2_langid(spark, folder).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 300
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    taught = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "text", None), (5, "", "fr")], "id long, text string, lang string")
    rows = [(1, None, 1), (2, "", 1), (3, "123 !", 1), (None, "the dog", 1), (None, "the dog", 1), (6, "le chien " * 40000, 1), (7, "дом", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {(r.doc.doc_id, r.language.lang_pred) for r in d.predict(docs, d.train(taught)).collect()}
    assert got >= {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (6, "fr")}
    assert {r.language.lang_pred for r in d.predict(docs, d.train(taught.limit(0))).collect()} == {"und"}
    full = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, score int, lang string")
    kept = d.keep_known(full)
    assert kept.columns == full.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 6, 7]
    assert d.keep_known(full.limit(0)).count() == 0


def test_texts_of_few_bytes_and_clashing_columns(spark):
    short = [(i, "abcdef"[: i + 1], "en") for i in range(6)] + [(10 + i, "xyzuvw"[: i + 1], "fr") for i in range(6)]
    taught = spark.createDataFrame(short, "id long, text string, lang string").repartition(12)
    docs = spark.createDataFrame([(i, t, n, 1, 2) for i, t, n in short], "doc_id long, text string, lang string, language int, bucket int").repartition(12)
    got = {r.doc.doc_id: r.language.lang_pred for r in d.predict(docs, d.train(taught)).collect()}
    assert got == {i: n for i, _, n in short}
    assert d.keep_known(docs).columns == docs.columns


def test_sample_and_trees_stay_within_their_bound(spark):
    rng = __import__("random").Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=60)), f"l{i % 200}") for i in range(4000)] + [(9999, "x" * 300_000, "l0")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    sizes = {r.lang: r.n for r in d.sample(docs, 20_000, 200_000).groupBy("lang").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert len(sizes) == 200 and all(1 <= n <= 6 for n in sizes.values())
    forest = d.train(docs, 2000)
    assert len(forest.langs) == 200 and len(__import__("pickle").dumps(forest)) < 200_000_000


def test_query_equals_a_plain_walk(spark):
    """Training sample and counts of the query, walked plainly over every text of the smallest table."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taught = docs.where(~d.held_out()).selectExpr("doc_id as id", "text", "lang").where("lang is not null and octet_length(text) > 0")
    counts = {}
    for r in d.sample(taught).collect():
        own = counts.setdefault(r.lang, [defaultdict(Counter) for _ in range(5)])
        for i in range(len(r.text)):
            for k in range(min(4, i) + 1):
                own[k][bytes(r.text[i - k : i])][r.text[i]] += 1
    got = {r.doc_id: r for r in op2_langid(spark, folder).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        bits = {lang: plain_bits(own, text[:3000]) for lang, own in counts.items()}
        if len(text) <= 3000:
            assert math.isclose(min(bits.values()) / len(text), got[r.doc_id].bits_per_byte, rel_tol=1e-4)
            assert bits[got[r.doc_id].lang_pred] - min(bits.values()) < 0.05

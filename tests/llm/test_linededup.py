import hashlib
from collections import Counter

import numpy as np

from millrace.llm import linededup as d


def plain(rows, least):
    """rows: (id, text) -> (id, n_lines, n_dropped, kept) of each"""
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or counts[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, size=(2, 5000), dtype=np.uint64)
    a[:100] = a[0]
    assert sorted(d.places(d.build(a, b), a, b)) == list(range(5000))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_KEYS", 16)
    rows = [(i, "\n".join([f"line {(i * 7 + k) % 60}" for k in range(i % 6)] + ([" HOT line\t"] if i % 3 else []) + ["", f"own {i}"])) for i in range(150)]
    rows += [(None, "line 5\nhot LINE"), (None, None), (7, ""), (8, "É\né\n Line 5 "), (9, "\n" * 3), (10, "line 5\n" * 30000)] + [(11, "same\nsame")] * 12
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_lines int")
    for share in (1000, 3):
        monkeypatch.setattr(d, "HOT_SHARE", share)
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in d.dedup_lines(docs, min_documents=10).collect()]
        assert sorted(got, key=repr) == sorted(plain(rows, 10), key=repr)
    assert d.dedup_lines(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from millrace.llm.catalog import op5_linededup

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain(rows, 10)}
    assert {tuple(r) for r in op5_linededup(spark, folder).collect()} == want

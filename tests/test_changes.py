"""Change messages, the change handler against a walk over dictionaries, and links watched through state and timers."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import changes, monitor

GOOD = [
    ({"changed": ["a", "b", "a"], "project": "p", "more": 1}, ("p", ["a", "b"], [], [])),
    ({"added": ["x/y.java"], "requirementsAdded": ["R1"]}, (None, [], ["x/y.java"], ["R1"])),
    ({"requirements_added": ["R2"], "requirementsAdded": None, "changed": []}, (None, [], [], ["R2"])),
    ({"changed": ["i" * 200], "project": None}, (None, ["i" * 200], [], [])),
]
BAD = ["", "{", "[]", "3", '"x"', "null", "{}", '{"changed": []}', '{"changed": "a"}', '{"changed": {"a": 1}}', '{"changed": [1]}', '{"changed": ["a", null]}', '{"changed": ["a b"]}', '{"changed": [""]}', json.dumps({"changed": ["i" * 201]}), json.dumps({"added": [str(k) for k in range(501)]}), '{"project": 3, "changed": ["a"]}', '{"project": "a b", "changed": ["a"]}', '{"changed": ["a"], "added": [["b"]]}']


def test_messages(spark):
    rows = [(k, json.dumps(m)) for k, (m, _) in enumerate(GOOD)] + [(100 + k, m) for k, m in enumerate(BAD)] + [(999, None)]
    got = {r["k"]: r for r in changes.parse_changes(spark.createDataFrame(rows, "k int, value string")).collect()}
    for k, (_, want) in enumerate(GOOD):
        assert got[k]["error"] is None and (got[k]["project"], got[k]["changed"], got[k]["added"], got[k]["requirements_added"]) == want
    for k, r in got.items():
        if k >= 100:
            assert r["error"] and not r["changed"] and not r["added"] and r["project"] is None, BAD[k - 100]


REQUIREMENTS = {"R1": "pay by card", "R2": "sign in", "R3": "print a bill"}
CODE = {"pay": "card pay", "card": "card", "login": "sign user in", "bill": "print bill", "print": "print page a"}


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "id string, text string")


def shared(a, b):
    return len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))


def verifier(spark, texts):
    """A link's confidence is three times what the texts share; none for the pair of R3 and print."""

    def verify(pairs):
        both = pairs.join(frame(spark, REQUIREMENTS).toDF("source_id", "s"), "source_id").join(frame(spark, texts).toDF("target_id", "t"), "target_id")
        x, y = F.split("s", " "), F.split("t", " ")
        score = 3 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        odd = (F.col("source_id") == "R3") & (F.col("target_id") == "print")
        return both.select("source_id", "target_id", F.lit(True).alias("is_linked"), F.when(~odd, F.least(F.lit(1.0), score)).alias("confidence"))

    return verify


def shortlist(queries, targets):
    x, y = F.split(F.col("q.text"), " "), F.split(F.col("t.text"), " ")
    return queries.alias("q").join(targets.alias("t"), F.arrays_overlap(x, y)).select(F.col("q.id").alias("query"), F.col("t.id").alias("target"))


def walk(links, message, code, batch):
    events, counts = [], dict(rechecked=0, decayed=0, candidates=0, linked=0)
    stamp = lambda s, t: hashlib.sha256(f"{REQUIREMENTS[s]}\0{code[t]}".encode()).hexdigest()
    score = lambda s, t: None if (s, t) == ("R3", "print") else min(1.0, 3 * shared(REQUIREMENTS[s], code[t]))
    known = set(links)
    for (s, t), (c, status, h, v, _) in sorted(links.items()):
        if t in message.get("changed", []) and status == "verified" and h != stamp(s, t) and score(s, t) is not None:
            counts["rechecked"] += 1
            if score(s, t) >= 0.5:
                links[s, t] = (score(s, t), "verified", stamp(s, t), v, batch)
            else:
                counts["decayed"] += 1
                links[s, t] = (score(s, t), "decayed", h, v, batch)
                events.append((s, t, c, score(s, t), batch))
    new = {(s, t) for s in REQUIREMENTS for t in code if shared(REQUIREMENTS[s], code[t]) and (s in message.get("requirementsAdded", []) or t in message.get("added", []))}
    for s, t in sorted(new - known):
        counts["candidates"] += 1
        if score(s, t) is not None and score(s, t) >= 0.5:
            counts["linked"] += 1
            links[s, t] = (score(s, t), "verified", stamp(s, t), batch, batch)
    return events, counts


STEPS = [
    ({"requirementsAdded": ["R1", "R2"]}, {}),
    ({"changed": ["card", "pay"]}, {"card": "no more"}),
    ({"changed": ["login"], "added": ["bill", "print"]}, {"login": "sign in now"}),
    ({"changed": ["card", "bill", "nothing"], "requirementsAdded": ["R3"]}, {"card": "card", "bill": "x"}),
]


def table(store):
    return {(r[0], r[1]): tuple(r)[2:] for r in store.current().collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0]) and a[k][1:] == b[k][1:], k


def test_handler_equals_a_walk_and_repeats_change_nothing(spark, tmp_path):
    store, code, links, events = changes.LinkStore(spark, str(tmp_path / "store")), dict(CODE), {}, []
    for batch, (message, edits) in enumerate(STEPS):
        code |= edits
        write = changes.handler(store, lambda: frame(spark, REQUIREMENTS), lambda: frame(spark, code), shortlist, verifier(spark, code))
        rows = spark.createDataFrame([(json.dumps(message),), ("broken",)], "value string")
        write(rows, batch)
        more, counts = walk(links, message, code, batch)
        events += more
        close(table(store), links)
        before = sorted(map(str, store.events().collect())), sorted(map(str, store.summaries().collect())), table(store)
        write(rows, batch)
        assert before == (sorted(map(str, store.events().collect())), sorted(map(str, store.summaries().collect())), table(store))
        last = {r["batch"]: r.asDict() for r in store.summaries().collect()}[batch]
        assert last == {"batch": batch, "errors": 1, **counts}
    got = sorted((r["requirementId"], r["codeEntityId"], r["previousConfidence"], r["newConfidence"], r["at"]) for r in store.events().collect())
    assert [(g[0], g[1], g[4]) for g in got] == sorted((e[0], e[1], e[4]) for e in events) and len(got) >= 1
    assert any(v[1] == "decayed" for v in links.values()) and any(v[3] == 2 for v in links.values())


def test_stream_of_messages_goes_on_where_it_stopped(spark, tmp_path):
    store = changes.LinkStore(spark, str(tmp_path / "store"))
    write = changes.handler(store, lambda: frame(spark, REQUIREMENTS), lambda: frame(spark, CODE), shortlist, verifier(spark, CODE))
    stream = lambda: spark.readStream.text(str(tmp_path / "in"))
    for k, message in enumerate([{"requirementsAdded": ["R1"]}, {"requirementsAdded": ["R2", "R1"]}]):
        spark.createDataFrame([(json.dumps(message),)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        monitor.drain(stream(), str(tmp_path / "at"), write)
        monitor.drain(stream(), str(tmp_path / "at"), write)
        assert {s for s, _ in table(store)} == {"R1", "R2"} if k else {"R1"}
    assert store.summaries().count() == 2


def test_watched_links(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        minute = 60_000
        parts = [
            [("R", "a", "verdict", "h1", 0.9, 1 * minute), ("R", "a", "change", "h1", 0.0, 2 * minute), ("R", "b", "verdict", "k1", 0.2, 1 * minute), ("S", "a", "verdict", "h1", 0.7, 1 * minute)],
            [("R", "a", "change", "h2", 0.0, 5 * minute), ("R", "b", "change", "k2", 0.0, 5 * minute), ("S", "a", "change", "h2", 0.0, 6 * minute)],
            [("R", "a", "verdict", "h2", 0.3, 7 * minute), ("R", "a", "change", "h3", 0.0, 8 * minute)],
            [("T", "z", "verdict", "q", 0.9, 500 * minute)],
            [("T", "z", "change", "q", 0.0, 501 * minute)],
        ]
        for part in parts:
            spark.createDataFrame(part, "source_id string, target_id string, kind string, text_hash string, confidence double, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("source_id string, target_id string, kind string, text_hash string, confidence double, at long").parquet(str(tmp_path / "in"))
            monitor.collect_to(changes.watch_links(stream, patience=30 * minute, late="1 minute"), str(tmp_path / "out"), str(tmp_path / "at"))
        got = sorted((r["source_id"], r["target_id"], r["kind"], r["at"] // minute, None if pd.isna(r["previous"]) else r["previous"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [("R", "a", "recheck", 5, 0.9), ("R", "a", "trace_decayed", 7, 0.9), ("S", "a", "overdue", 36, 0.7), ("S", "a", "recheck", 6, 0.7)]
    finally:
        spark.conf.set(name, before)

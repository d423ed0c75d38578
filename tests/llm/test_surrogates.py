import re

import pytest

from millrace.llm import surrogates as s

KEY = b"test key"


def test_formats_and_coreference():
    text = 'Mr. John Smith (John.Smith@mail.example.com, +1 (555) 123-4567) met Mrs. Anna Smith; Mr. Smith wrote to john.smith@MAIL.example.com from 10.0.0.1, 4111 1111 1111 1111, 4111111111111111, token = "0123456789abcdef0123456789abcdef01234567", +1-555-123-4567. Госпожа Иванова.'
    new, n = s.rewrite(KEY, text, {})
    assert n == len(s.mentions(text)) == 14
    assert not re.search(r"John|Anna|Smith|smith|555|10\.0\.0\.1|4111|0123456789|Иванова", new)
    names = re.findall(r"(?:Mr|Mrs)\. (\w+)(?: (\w+))?", new)
    assert names[0][1] == names[1][1] == names[2][0]
    phones = re.findall(r"\+1[ \d()-]+\d", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert len({c.replace(" ", "") for c in cards}) == 1 and s._luhn(cards[1]) == 0
    mails = re.findall(r"[\w.]+@[\w.]+", new)
    assert len({m.lower() for m in mails}) == 1 and mails[0] != mails[1]
    assert re.search(r"Госпожа [А-Яа-я]+\.$", new)
    assert s.rewrite(b"other key", text, {})[0] != new and s.rewrite(KEY, text, {})[0] == new


def test_distinct_over_collisions(spark):
    values = [(f"surname", f"name{i}") for i in range(3000)] + [("surname", s.surrogate(KEY, "surname", "name7"))]
    out = s.draw_all(spark.createDataFrame(values, "kind string, value string"), KEY).collect()
    drawn = [r.surrogate for r in out]
    assert len(out) == len(set(drawn)) == 3001
    assert not set(drawn) & {v for _, v in values}
    assert any(r.attempt for r in out)


def test_both_ways_of_telling_agree(spark, monkeypatch):
    people = [f"Mr. {chr(65 + i % 26)}{'abcdefgh'[i // 26 % 8]}{'klmnop'[i % 6]} met Herr Xyz{'abc'[i % 3]}" for i in range(600)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(people)], "doc_id long, text string")
    monkeypatch.setattr(s, "surrogate", lambda key, kind, value, attempt=0, f=s.surrogate: f(key, kind, value, attempt) if attempt else "same")
    one = sorted(r.text for r in s.replace(docs, KEY).collect())
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert sorted(r.text for r in s.replace(docs, KEY).collect()) == one


def test_query_leaves_none_of_the_old_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {d.doc_id: d.text for d in docs.collect()}
    entities = {(k, v) for t in old.values() for _, _, k, v in s.mentions(t)}
    assert {k for k, _ in entities} >= {"email", "phone", "ip", "card", "secret"}
    values = {v for _, v in entities}
    for r in s.replace(docs, KEY).collect():
        assert r.n_replaced == len(s.mentions(old[r.doc_id]))
        assert not {v for _, _, _, v in s.mentions(r.text)} & values
        assert r.n_replaced or r.text == old[r.doc_id]


def test_edge_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "@ . 1.2.3.4.5 999.1.1.1 a@b", 3), (None, "x@y.zz", 3), (None, "x@y.zz", 3), (4, "word " * 60000 + "x@y.zz", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_replaced int")
    got = s.replace(docs, KEY).collect()
    assert sorted((r.doc_id or -1, r.n_replaced) for r in got) == [(-1, 1), (-1, 1), (1, 0), (2, 0), (3, 1), (4, 1)]
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[None].text == by[4].text[-6:]
    assert s.replace(docs.limit(0), KEY).count() == 0


def test_later_mentions_of_a_name_and_more_shapes():
    text = "Mr. John Smith came. Later John Smith left and Smith's dog wrote. Smithson stayed. +15551234567, +33 1 23 45 67 89, +49 30 123456, 555-123-4567, 2001:0db8:0000:0000:0000:ff00:0042:8329, token=eyJhbGciOiJI.eyJzdWIi/MTIzNA+x.c2ln"
    new, n = s.rewrite(KEY, text, {})
    assert n == 11 and not re.search(r"John|Smith\b|5551234567|23 45 67|123456\b|123-4567|8329|eyJ|c2ln", new) and "Smithson stayed." in new
    first, last = re.match(r"Mr\. (\w+) (\w+) came\. ", new).groups()
    assert f"Later {first} {last} left and {last}'s dog" in new
    long = "a" * 300 + "@x.org"
    assert s.mentions(long) == [(0, len(long), "email", long)]


def test_no_endless_drawing(spark, monkeypatch):
    monkeypatch.setattr(s, "ATTEMPTS", 3)
    monkeypatch.setattr(s, "surrogate", lambda key, kind, value, attempt=0: "same")
    with pytest.raises(ValueError, match="no free surrogate"):
        s.draw_all(spark.createDataFrame([("phone", "1"), ("phone", "2")], "kind string, value string"), KEY)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x@y.zz", 1, 2, 3)], "doc_id long, text string, _new int, _key int, doc int")
    got = s.replace(docs, KEY)
    assert got.columns == [*docs.columns, "n_replaced"] and [tuple(r)[2:] for r in got.collect()] == [(1, 2, 3, 1)]

import os

from pyspark.sql import functions as F

from millrace.sources import readers, sinks
from millrace.streaming import monitor

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for number, part in enumerate((events.where("day(ts) <= 10"), events.where("day(ts) > 10"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    late = events.where("day(ts) = 2").limit(5).coalesce(1)
    late.write.parquet(str(tmp_path / "in/2"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for number in range(3):
        source = next((tmp_path / f"in/{number}").glob("part-*.parquet"))
        (flat / f"{number}.parquet").write_bytes(source.read_bytes())
        os.utime(flat / f"{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))  # a stream takes files by age
    stream = monitor.file_stream(spark, events, str(flat))
    got = monitor.collect_to(monitor.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "place"))
    want = monitor.tumbling(events)
    closed = got.agg(F.max("window_start")).first()[0]
    rows = lambda df: sorted((str(r.window_start), r.event_type, r.events) for r in df.where(F.col("window_start") <= F.lit(closed)).collect())
    assert rows(got) == rows(want)


def test_monitor_rechecks_changed_links_only(spark, tmp_path):
    links = spark.createDataFrame([("r1", "c1", "verified", "old"), ("r1", "c2", "verified", "same"), ("r2", "c1", "decayed", "old"), ("r2", "c3", "verified", "old")], "source_id string, target_id string, status string, text_hash string")
    changes = spark.createDataFrame([("c1", "new", 1), ("c2", "same", 1), ("c1", "newer", 2)], "id string, text_hash string, at int")
    changes.write.parquet(str(tmp_path / "changes"))
    saved = []
    write = monitor.monitor(lambda: links, lambda due: due.withColumn("accepted", F.col("source_id") != "r1"), lambda out, batch: saved.extend(tuple(r) for r in out.collect()))
    monitor.drain(monitor.file_stream(spark, changes, str(tmp_path / "changes"), 100), str(tmp_path / "place"), write)
    assert saved == [("r1", "c1", "decayed", "newer")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,\n2,x\n".encode())
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), None).orderBy("id").collect()] == [("1", None), ("2", "x")]
    assert [tuple(r) for r in readers.text_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [("1", ""), ("2", "x")]
    (tmp_path / "mixed.txt").write_bytes("é\n".encode() + b"\xe9\n")
    assert [(r.line, r.repaired) for r in readers.decoded_lines(spark, str(tmp_path / "mixed.txt")).orderBy("line_no").collect()] == [("é", False), ("é", True)]
    (tmp_path / "list.json").write_text('[{"id": 1}]')
    (tmp_path / "wrapped.json").write_text('{"results": [{"id": 2}]}')
    for name, want in (("list", 1), ("wrapped", 2)):
        assert [r.id for r in readers.json_records(spark, str(tmp_path / f"{name}.json"), "struct<id: int>", ["results", "executions"]).collect()] == [want]
    (tmp_path / "log.jsonl").write_text('{"type": "a"}\n{"type": "b"}\n{"type": "c')
    assert sorted(r.type for r in readers.json_log(spark, str(tmp_path / "log.jsonl"), "type string").collect()) == ["a", "b"]
    (tmp_path / "t.arff").write_text("@relation x\n% NFR, 3, must, be fast,1\n")
    assert [tuple(r) for r in readers.arff_payload(spark, str(tmp_path / "t.arff")).collect()] == [("NFR", 3, "must, be fast", "1")]
    (tmp_path / "r.xml").write_text('<testsuite><testcase classname="A" name="b()[1]" time="0.5"/><testcase classname="A" name="c" time="1"><failure>x</failure><error>y</error></testcase><testcase classname="A" name="d" time="0"><skipped>z</skipped></testcase></testsuite>')
    assert sorted((r.method_name, r.status, r.duration_ms) for r in readers.surefire(spark, str(tmp_path / "r.xml")).collect()) == [("b", "PASS", 500.0), ("c", "FAIL", 1000.0), ("d", "SKIPPED", 0.0)]
    page = spark.createDataFrame([("<head><title>t</title></head><p>a &amp; b</p><script>x</script>c<br>d",), (None,)], "html string")
    assert [r.t for r in page.select(readers.html_text(F.col("html")).alias("t")).collect()] == ["a & b\nc\nd", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert sinks.write_once(df, str(tmp_path / "t")) and not sinks.write_once(df.orderBy(F.desc("id")), str(tmp_path / "t"))
    try:
        sinks.write_once(df.limit(1), str(tmp_path / "t"))
        raise AssertionError("no error")
    except ValueError:
        pass
    sinks.write_csv(df, str(tmp_path / "c"), ["name", "id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["name", "id"]
    assert sinks.manifest(spark, str(tmp_path / "t")).where("length(sha256) = 64").count() > 0

"""Encoding repair against Python's codecs, and mixed CSV files against Python's reader."""

import csv
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import encoding
from millrace.sources import readers

CLASS = re.compile("[ÃÂâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,2}")


def repaired(text):
    def fix(m):
        try:
            return m[0].encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m[0]

    return CLASS.sub(fix, text)


def test_mojibake_equals_the_codecs(spark):
    rng = np.random.default_rng(6)
    letters = list("ÃÂâ©®€™œ§¿\u0081\u0090 ab é’‚") + ["Ã©", "â€™", "Â§", "â€œ"]
    texts = ["".join(rng.choice(letters, size=int(rng.integers(0, 12)))) for _ in range(600)]
    texts += ["cafÃ© â€™sÂ§", "", "plain", "â€", "Ãé", "“ Quoted TEXT ”", "'a' and 'b'", "x   y\n"]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    for r in rows.select("id", "text", encoding.repair_mojibake(F.col("text")).alias("r"), encoding.normalize_repaired(F.col("text")).alias("n")).collect():
        if r["text"] is None:
            assert tuple(r["r"]) == (None, False) and r["n"] is None
            continue
        want = repaired(r["text"])
        assert tuple(r["r"]) == (want, want != r["text"]), r["text"]
        clean = repaired(re.sub(r"\s+", " ", r["text"].replace(" ", " ")).strip())
        m = re.match(r"^(['\"“‘`]+)(.*?)(['\"”’`]+)$", clean, re.S)
        assert r["n"] == (m[2].strip() if m else clean).lower()


def plain(content):
    """Line by line as the file's owner reads it, then by Python's CSV reader."""
    import codecs

    codecs.register_error("stray_test", lambda e: (e.object[e.start : e.end].decode("cp1252", "replace"), e.end))
    flags, lines = [], []
    for chunk in content.split(b"\n"):
        try:
            text, used = chunk.decode("utf-8"), False
        except UnicodeDecodeError:
            text, used = chunk.decode("utf-8", "stray_test"), True
        flags.append(used)
        lines.append(text + "\n")
    reader = csv.reader(lines)
    header, rows, before = next(reader), [], 0
    before = reader.line_num
    for record in reader:
        if record:
            rows.append((*record, any(flags[before : reader.line_num])))
        before = reader.line_num
    return [h.lstrip("﻿") for h in header], rows


@pytest.mark.parametrize("block", ["128m", "64"])
def test_mixed_csv_equals_the_reader(spark, tmp_path, block):
    """Also where a task reads a few bytes of the file only."""
    rng = np.random.default_rng(8)
    parts = [b"id,te xt,note"]
    for k in range(80):
        cell = [b"plain", "é’".encode(), b"caf\xe9", b'"two\nlines, ""quoted"" \xe2"', b'""', b"", b'"\n\n"', b'"a ""b"""'][int(rng.integers(0, 8))]
        parts.append(b"%d,%s,%s" % (k, cell, [b"x", b"\x93y\x94", b'"z\nw"'][int(rng.integers(0, 3))]))
        if k % 9 == 0:
            parts.append(b"")
    content = b"\xef\xbb\xbf" + b"\n".join(parts) + b"\n"
    (tmp_path / "a.csv").write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = readers.mixed_csv(spark, str(tmp_path / "a.csv"))
        names, want = plain(content)
        assert out.columns == [*names, "encoding_repaired"]
        if block == "64":
            assert readers.raw_lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count() > 5
        got = sorted(map(tuple, out.collect()), key=lambda r: int(r[0]))
        assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_bytes(b"")
    assert readers.mixed_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "header.csv").write_bytes(b"a,b\n")
    out = readers.mixed_csv(spark, str(tmp_path / "header.csv"))
    assert out.columns == ["a", "b", "encoding_repaired"] and out.count() == 0

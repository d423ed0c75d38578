"""Texts that were decoded wrongly: UTF-8 that was read as Windows-1252, and lines in which both are mixed."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for the bytes 80 to 9F in Windows-1252, by the codec itself; some of them stand for nothing.
HIGH = {chr(b): b for b in range(0xA0, 0xC0)} | {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}
# Fixed value: a lead byte and one or two that may follow it, as Windows-1252 shows them.
MOJIBAKE = "[ÃÂâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,2}"
LEADS = {"Ã": "C3", "Â": "C2", "â": "E2"}
QUOTED = r"(?s)^(['\"“‘`]+)(.*?)(['\"”’`]+)$"


def repair_mojibake(text: Column) -> Column:
    """Struct (text, repaired): every sequence that is the Windows-1252 reading of one character in UTF-8 is this character
    again, others stay. Null stays null and is not repaired."""
    follow = "".join(HIGH)
    byte = F.create_map(*(F.lit(x) for c, b in HIGH.items() for x in (c, f"{b:02X}")), *(F.lit(x) for pair in LEADS.items() for x in pair))
    # two bytes after Ã or Â and three after â are a character; only letters that the code page has are bytes
    valid = f"^(?:[ÃÂ][{follow}]|â[{follow}]{{2}})$"
    read = lambda m: F.unhex(F.array_join(F.transform(F.split(m, ""), lambda c: F.try_element_at(byte, c)), "")).cast("string")
    between = F.split(text, MOJIBAKE, -1)
    fixed = F.transform(F.regexp_extract_all(text, F.lit(MOJIBAKE), 0), lambda m: F.when(m.rlike(valid), read(m)).otherwise(m))
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("part"), fixed.alias("then")), lambda z: F.concat(z["part"], F.coalesce(z["then"], F.lit("")))), "")
    out = F.when(text.isNotNull(), whole)
    return F.struct(out.alias("text"), F.coalesce(out != text, F.lit(False)).alias("repaired"))


def collapse_all(text: Column) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "), "^ | $", "")


def normalize_repaired(text: Column) -> Column:
    """Lower case of the collapsed and repaired text, without quotes around the whole."""
    clean = repair_mojibake(collapse_all(text))["text"]
    inner = F.regexp_replace(F.regexp_extract(clean, QUOTED, 2), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return F.lower(F.when(clean.rlike(QUOTED), inner).otherwise(clean))


def _stray(error: UnicodeDecodeError) -> tuple[str, int]:
    """Only the bytes that are no UTF-8 are read as Windows-1252."""
    return error.object[error.start : error.end].decode("cp1252", errors="replace"), error.end


@F.pandas_udf(T.StringType())
def _mixed(lines: pd.Series) -> pd.Series:
    codecs.register_error("stray_cp1252", _stray)
    return pd.Series([line.decode("utf-8", errors="stray_cp1252") for line in lines], dtype=object)


def decoded(line: Column) -> Column:
    """Struct (text, repaired) of a line in raw bytes: UTF-8 as it is, and bytes that are none as Windows-1252."""
    fine = F.is_valid_utf8(line.cast("string"))
    return F.struct(F.when(fine, line.cast("string")).otherwise(_mixed(line)).alias("text"), (~fine).alias("repaired"))

"""Column functions that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole``, ``empty`` where the denominator is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def symmetric_change(old: Column, new: Column) -> Column:
    """``|new - old| / (|old| + |new|)``: zero if both are zero, null if either is null."""
    total = F.abs(old) + F.abs(new)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(new - old) / total)


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the values that are there; null if none is."""
    there = F.filter(F.array(*values), lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(there) > 0, total / F.size(there))


def truthy(text: Column) -> Column:
    """Boolean strings: true, 1 and yes in any case and with spaces around."""
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def finite(value: Column) -> Column:
    """``value`` as a double, null where it is no finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; where unset, a local master
    gets one of its own and any other an error."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()

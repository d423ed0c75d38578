"""Numbers and running sums over a whole table in an order, without one task that orders it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed


def running_sum(rows: DataFrame, order: Sequence[str | Column], out: str, amount: str | None = None) -> DataFrame:
    """``rows`` with ``out``, the sum of ``amount`` (without one, the number) of all rows up to each in ``order``, itself included.

    Rows are dealt by ranges of the order, which Spark takes from a sample, and stored, so that a task that is repeated finds
    them dealt as before. Each part sums up its own rows, and the sums of the parts before it, one row a part, are added. Rows that
    are equal in the order are in one part and stand in any sequence there; nulls of a column come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1).cast("long") if amount is None else F.col(amount)
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumns({"_part": F.spark_partition_id(), "_value": value}))
    sums = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_part").withColumn(out, own + F.col("_before")).drop("_part", "_value", "_before")

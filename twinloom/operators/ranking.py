"""Global ranks without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.storage import written


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based rank in the given order as column ``name``.

    Rows are dealt by ranges of the order and sorted there; Spark's row numbers then
    hold the range and the place in it, and a rank is that place plus the number of
    rows in the ranges before, one number a range. Rows move once.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(sorted_.withColumn("_place", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumns({"_pid": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(2**33 - 1)})
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_place")).drop("_pid", "_place", "_before")


def running_sums(df: DataFrame, group: str, order: str, sums: list[str]) -> DataFrame:
    """``df`` with the running sum ``run_<c>`` of each column, by ``order`` within ``group``.

    The same two steps: sums within ranges, and what the ranges before hold of the group.
    """
    ranged = written(df.repartitionByRange(group, order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(group, "_pid").agg(*[F.sum(c).alias("_t" + c) for c in sums])
    w = Window.partitionBy(group).orderBy("_pid")
    before = totals.select(group, "_pid", *[(F.sum("_t" + c).over(w) - F.col("_t" + c)).alias("_b" + c) for c in sums])
    own = Window.partitionBy(group, "_pid").orderBy(order)
    out = ranged.join(before, [group, "_pid"])
    return out.withColumns({"run_" + c: F.col("_b" + c) + F.sum(c).over(own) for c in sums}).drop("_pid", *["_b" + c for c in sums])

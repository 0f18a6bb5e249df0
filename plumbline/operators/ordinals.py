"""Sums over all rows before, and ordinals, without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize


def running_totals(rows: DataFrame, by: list[Column | str], amount: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before, in the order of ``by``, in column ``out``.

    The rows are range-partitioned and written, so that the cut points stand;
    each partition is then summed once, and only one number per partition
    reaches the driver.  No task sees more than a partition.  Rows equal in
    ``by`` stand in any order.  An empty table stays empty.
    """
    ranged = materialize(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = {r["__part"]: r["s"] for r in ranged.groupBy("__part").agg(F.sum(amount).alias("s")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before bigint")
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")
    )


def ordinals(rows: DataFrame, by: list[Column | str], out: str) -> DataFrame:
    """``rows`` numbered from 0 in the order of ``by``."""
    return running_totals(rows.withColumn("__one", F.lit(1)), by, "__one", out).drop("__one")

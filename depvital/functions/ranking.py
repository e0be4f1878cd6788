"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.session import cut_lineage


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group 1..n in the given total order.

    A window over the group alone would sort a group in one task, and one group may hold much of the data.
    Rows are range-partitioned by group and order, written once with their slice number, and numbered
    inside (slice, group); counts per slice, a small table, give what comes before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.repartitionByRange(n, F.col(group), *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice", group).orderBy(*order)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [group, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_inside", "_before")
    )

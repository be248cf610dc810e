"""Global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.scratch import checkpointed


def ranked(df: DataFrame, group: str, order: str, name: str = "pos", dealt: bool = False) -> DataFrame:
    """df with each row's rank (from 0) in its group, by `order`, which must be unique in a group.

    A range partition deals the rows out, each partition counts its rows of a group, and running sums of these counts
    (one row for each partition and group at most) are the offsets.  dealt: df is range partitioned by group and order.
    """
    dealt = (df if dealt else df.repartitionByRange(group, order)).sortWithinPartitions(group, order)
    dealt = checkpointed(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = checkpointed(counts.select(group, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__offset")))  # measured, so that rows are not moved
    joined = dealt.join(offsets, [group, "__part"])
    return joined.withColumn(name, F.col("__offset") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__first", "__offset")

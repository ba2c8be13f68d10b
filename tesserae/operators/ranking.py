"""Running sums within groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import settled


def running(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """df with `before`, the sum of `value` over the rows of its group that stand earlier in `order`, and `total`, its sum over the group.

    Rows are range-partitioned by group and order, settled there, and summed up by partition; a row
    adds what stands before it in its own partition to the sums of those before.
    """
    p = settled(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__p", F.spark_partition_id()))
    sums = p.groupBy(*by, "__p").agg(F.sum(value).alias("__s"))
    every = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = F.coalesce(F.sum("__s").over(every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__p").alias("__q"), earlier.alias("__b"), F.sum("__s").over(every).alias("total"))
    on = F.col("__p") == F.col("__q")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # sums has a row for each group and partition
    return p.withColumn("__o", own).join(sums, on).withColumn("before", F.col("__b") + F.col("__o")).drop("__p", "__q", "__s", "__b", "__o", *[f"__{c}" for c in by])

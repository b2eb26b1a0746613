"""Running totals over an order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def hash_bucket(hashed: str, buckets: int = BUCKETS) -> Column:
    """Number of the bucket of a hexadecimal hash, in the order of the hash."""
    return F.floor(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, bucket: Column) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows of its group in the order of the columns ``order``.

    ``bucket`` is a number that never falls along the order. Totals per bucket
    (groups times buckets rows, whatever the data) are added up over the
    buckets; within a bucket a window orders what lies there, so the buckets
    bound a task to a fraction of the largest group.
    """
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*group).orderBy("_b")
    before = sums.withColumn("_before", F.sum("_s").over(w) - F.col("_s")).drop("_s")
    near = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_near", F.sum("_v").over(near) - F.col("_v"))
    return rows.join(before, [*group, "_b"]).withColumn(name, F.col("_before") + F.col("_near")).drop("_b", "_v", "_near", "_before")

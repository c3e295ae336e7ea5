"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a row number from 0 in the given order.

    Rows are dealt by ranges of the order and numbered within their part; the
    parts' sizes, one row each, give where every part starts.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_row", F.row_number().over(inside) - 1).join(F.broadcast(start), "_part").withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")

"""Running sums and row numbers over orders that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.shared import store


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value (a long) over the rows of the same group up to and with each.

    Rows are dealt by ranges of group and order, written once so that the ranges stay, and summed by range; what
    stands in earlier ranges is added to the sum inside a range. Order must tell a group's rows apart. Nulls make a
    group, and stand first in an order.
    """
    dealt = store(rows.withColumn(name, value.cast("long")).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), name)
    group = F.struct(F.lit(0), *by)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(group.alias("_group"), F.col("_part")).agg(F.sum(name).alias("_sum"))
    above = sums.select("_group", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_group", group).withColumn(name, F.sum(name).over(inside))
    return summed.join(above, ["_group", "_part"]).withColumn(name, F.col(name) + F.col("_above")).drop("_group", "_part", "_above")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: their numbers in their group, from 1."""
    return running(rows, by, order, F.lit(1), name)

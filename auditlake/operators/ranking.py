"""Order inside groups of any size: rows are cut into range parts, and parts are stitched with one row each.

A group that holds a third of all rows is spread over as many parts as its rows
fill; no task orders a whole group and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import cut_lineage


def in_parts(df: DataFrame, keys: list[str], order: list[str], part: str = "part") -> DataFrame:
    """Adds the number of the row's range part in (keys, order); parts rise with the order and hold about as many rows each.

    The result is checkpointed, for a repeated task could draw other borders.  Rows that are equal in
    all of ``order`` share a part, so the order should tell rows apart.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(ranged.withColumn(part, F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys up to this one; null keys are a group of their own."""
    part, local, before = "__part", "__local", "__before"
    rows = in_parts(df, keys, order, part)
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(local, F.sum(value).over(inside))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, part).agg(F.sum(value).alias("__n"))
    totals = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col(part).alias("__of_part"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(before))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.col(part) == F.col("__of_part"))
    return summed.join(totals, same).select(*df.columns, (F.col(before) + F.col(local)).alias(name))


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place (from 1) among the rows of its keys; null keys are a group of their own."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), keys, order, "__one", name).drop("__one")

"""What stands before a row in its group's order, without a window over the whole group.

A group may hold a third of all rows. Rows are laid out in blocks of the order's first column; windows run within (group, block), and one
row per block carries over what the block before ended with. A group's blocks are as many as its span asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_before(df: DataFrame, keys: list[str], order: list[str], carried: list[str], block: Column, name: str = "before") -> DataFrame:
    """df with a struct name of the columns carried of the row before it, by order, among the rows of its keys; null for the first.

    block: a number that never falls along the order. Keys compare null-safe.
    """
    x = df.withColumn("__block", block)
    within = Window.partitionBy(*keys, "__block").orderBy(*order)
    x = x.withColumn("__in", F.lag(F.struct(*carried)).over(within))
    ends = x.groupBy(*keys, "__block").agg(F.max(F.struct(*order, F.struct(*carried).alias("__c"))).alias("__last"))
    ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), F.lag("__last.__c").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carried"))
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return x.join(ends, same).withColumn(name, F.coalesce("__in", "__carried")).drop("__block", "__in", "__carried", "__b", *[f"__k{i}" for i in range(len(keys))])


def with_running(df: DataFrame, keys: list[str], order: list[str], number: str, block: Column, name: str = "so_far") -> DataFrame:
    """df with the sum of a number up to and with each row, by order, among the rows of its keys: within blocks, and over the blocks."""
    x = df.withColumn("__block", block)
    within = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__in", F.sum(number).over(within))
    sums = x.groupBy(*keys, "__block").agg(F.sum(number).alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__carried"))
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return x.join(sums, same).withColumn(name, F.col("__in") + F.col("__carried")).drop("__block", "__in", "__carried", "__b", *[f"__k{i}" for i in range(len(keys))])

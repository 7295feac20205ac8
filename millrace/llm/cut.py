"""Exact cut of an order at a budget, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.durable import broadcast_if_small, durable


def cuts(rows: DataFrame, group: str, bucket: str, size: str, budget: str) -> DataFrame:
    """``cut_group, cut_bucket, start, split``: the bucket in which each group's budget ends, what lies before it, and whether it is to be split.

    Groups that their budget covers are absent. Where it ends just before the bucket, nothing of that is taken and it is not split.
    """
    before = Window.partitionBy(group).orderBy(bucket)
    sums = rows.groupBy(group, bucket).agg(F.sum(size).alias("s"), F.first(budget).alias("budget"))
    ends = sums.withColumn("end", F.sum("s").over(before)).filter(F.col("end") > F.col("budget"))
    start = F.col("end") - F.col("s")
    cut = ends.groupBy(group).agg(F.min(F.struct(bucket, start.alias("start"), (start < F.col("budget")).alias("split"))).alias("cut"))
    return cut.select(F.col(group).alias("cut_group"), F.col(f"cut.{bucket}").alias("cut_bucket"), "cut.start", "cut.split")


def _running(rows: DataFrame, group: str, order: list[Column], size: str) -> DataFrame:
    """``rows`` with ``upto_``, the sum of ``size`` in the group up to each row. Ranges of the order are dealt to tasks, ties too."""
    keys = [group, *order, "tie_"]
    dealt = rows.withColumn("tie_", F.rand(7)).repartitionByRange(*keys).withColumn("range_", F.spark_partition_id())
    dealt = durable(dealt)
    sums = dealt.groupBy(group, "range_").agg(F.sum(size).alias("s"))
    earlier = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("g_"), F.col("range_").alias("r_"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("earlier_"))
    sums = broadcast_if_small(durable(sums), 100_000)
    within = Window.partitionBy(group, "range_").orderBy(*order, "tie_").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("within_", F.sum(size).over(within))
    joined = summed.join(sums, F.col(group).eqNullSafe(F.col("g_")) & (F.col("range_") == F.col("r_")))
    return joined.withColumn("upto_", F.col("earlier_") + F.col("within_")).drop("g_", "r_", "tie_", "range_", "within_", "earlier_")


def take_until(rows: DataFrame, group: str, order: list[Column], bucket: str, size: str, budget: str) -> DataFrame:
    """``rows`` with ``picked``: in each group, the first rows by ``order`` up to ``budget`` of ``size``.

    A row is taken if the middle of its size lies within the budget, so the sum misses the budget by half
    a row at most; with size 1 and a whole budget exactly so many rows are taken. Where the budget ends between two buckets, rows of no
    size beyond it are not taken. ``bucket`` is a whole number that never falls along ``order``; one bucket of a group holds the cut, and only
    its rows are sorted, in ranges, so that a bucket with very many rows (equal ids) is as good as any other. Sums of
    buckets are combined map-side, so a group with a third of all rows is too. ``rows`` is read four times.
    """
    cut = broadcast_if_small(durable(cuts(rows, group, bucket, size, budget)), 100_000)
    placed = rows.join(cut, F.col(group).eqNullSafe(F.col("cut_group")), "left")
    at_cut = F.coalesce((F.col(bucket) == F.col("cut_bucket")) & F.col("split"), F.lit(False))
    whole = placed.filter(~at_cut).withColumn("picked", F.coalesce(F.col(bucket) < F.col("cut_bucket"), F.lit(True)))
    split = _running(placed.filter(at_cut), group, order, size)
    split = split.withColumn("picked", 2 * (F.col("start") + F.col("upto_")) - F.col(size) <= 2 * F.col(budget)).drop("upto_")
    return whole.unionByName(split).drop("cut_group", "cut_bucket", "start", "split")

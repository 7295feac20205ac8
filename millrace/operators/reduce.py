"""Reducers: the result takes the relation's place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.registry import operator


@operator("field_count_reducer", "table")
def field_count_reducer(df: DataFrame, field: str) -> DataFrame:
    """Rows of each value, null being one."""
    return df.groupBy(f"`{field}`").count()


@operator("array_flatmap_count_reducer", "table")
def array_flatmap_count_reducer(df: DataFrame, field: str) -> DataFrame:
    """How often each element occurs over all arrays; null elements count, null arrays do not."""
    return df.select(F.explode(F.col(f"`{field}`")).alias(field)).groupBy(f"`{field}`").count()


@operator("filter_obscure_char_reducer", "table")
def filter_obscure_char_reducer(df: DataFrame, field: str, cumsum_rate: float = 0.99) -> DataFrame:
    """``char, frequency, cumsum, cumsum_rate`` of the rare characters: those at which the running share, most frequent first, has reached the rate.

    The window sees one row for each character there is, whatever the corpus.
    """
    chars = df.select(F.explode(F.filter(F.split(F.col(f"`{field}`"), ""), lambda c: c != "")).alias("char"))
    counts = chars.groupBy("char").agg(F.count("*").alias("frequency"))
    running = Window.orderBy(F.desc("frequency"), "char").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("cumsum", F.sum("frequency").over(running)).withColumn("all_", F.sum("frequency").over(Window.partitionBy()))
    return sums.withColumn("cumsum_rate", F.col("cumsum") / F.col("all_")).filter(F.col("cumsum_rate") >= cumsum_rate).drop("all_")


@operator("percentile_reducer", "table")
def percentile_reducer(df: DataFrame, field: str, percentile: float = 0.95) -> DataFrame:
    """One row with the percentile of a number column, nulls left out."""
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must lie between 0 and 1")
    return df.agg(F.percentile_approx(F.col(f"`{field}`"), percentile, 10000).alias(field))

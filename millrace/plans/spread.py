"""Dealing a small input to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input up to which a shuffle costs less than idle cores.
SMALL = 256 << 20


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table read from fewer files than there are cores and of at most ``most`` bytes, its rows dealt evenly; any other as it is.

    A file of one row group is read by one task, however many cores there are. Nothing is read or listed here but what the plan has
    already listed; selections and filters put on the result still reach the scan.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)

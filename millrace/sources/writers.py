"""Sinks. What they are given passes through."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import operator


@operator("path_writer", "sink")
def path_writer(df: DataFrame, path: str, format: str, mode: str) -> None:
    """Files of one of Spark's formats."""
    df.write.format(format).mode(mode).save(path)


@operator("hive_table_writer", "sink")
def hive_table_writer(
    df: DataFrame,
    table_name: str,
    save_mode: Literal["append", "overwrite", "errorifexists", "ignore"],
    is_external: bool = False,
    external_location: str | None = None,
    format_type: Literal["parquet", "orc", "csv"] = "parquet",
    partition_by: list[str] | None = None,
    dynamic_partition_overwrite: bool = False,
    options: dict | None = None,
) -> None:
    """A catalog table, external or managed. A dynamic overwrite replaces only the partitions that the rows are of."""
    if is_external and not external_location:
        raise ValueError("an external table needs external_location")
    missing = [c for c in partition_by or [] if c not in df.columns]
    if missing:
        raise ValueError(f"partition columns are missing: {missing}")
    spark, dynamic = df.sparkSession, dynamic_partition_overwrite and save_mode == "overwrite"
    if dynamic and spark.catalog.tableExists(table_name):
        # overwriting by saveAsTable would drop the table; the mode of the session is put back afterwards
        key = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key, "static")
        spark.conf.set(key, "dynamic")
        try:
            df.select(*(F.col(f"`{c}`") for c in spark.table(table_name).columns)).write.insertInto(table_name, overwrite=True)
        finally:
            spark.conf.set(key, before)
        return
    writer = df.write.format(format_type).mode(save_mode).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if is_external:
        writer = writer.option("path", external_location)
    writer.saveAsTable(table_name)

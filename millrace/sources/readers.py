"""Sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import operator
from millrace.plans.spread import spread as spread_small

FORMATS = ("csv", "json", "parquet", "orc", "text", "image", "binaryFile")


@operator("regular_path_reader", "source")
def regular_path_reader(spark: SparkSession, input_path: str, format: str, options: dict | None = None, spread: bool = False) -> DataFrame:
    """Files of one of Spark's formats. CSV has a header unless ``options`` says otherwise.

    ``spread``: a small input in few files is dealt to all cores, which pays where costly operators follow.
    """
    by_lower = {f.lower(): f for f in FORMATS}
    if format.lower() not in by_lower:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    defaults = {"header": "true"} if format.lower() == "csv" else {}
    chosen = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (options or {}).items()}
    df = spark.read.format(by_lower[format.lower()]).options(**{**defaults, **chosen}).load(input_path)
    return spread_small(df) if spread else df


@operator("whole_text_file_reader", "source")
def whole_text_file_reader(spark: SparkSession, input_path: str) -> DataFrame:
    """``file_path, text``: a row for each file."""
    return spark.read.text(input_path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


@operator("hive_reader", "source")
def hive_reader(spark: SparkSession, table_name: str) -> DataFrame:
    """A table of the catalog."""
    return spark.table(table_name)

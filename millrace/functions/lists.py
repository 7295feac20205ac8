"""Small resource files, read on the driver: local ones, or any that Spark's file systems reach. What workers need of them is sent along."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def read_text(path: str) -> str:
    """The file's text, or that of a folder's files."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise FileNotFoundError(path)
    try:
        return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException as e:
        raise FileNotFoundError(path) from e

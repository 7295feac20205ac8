"""Reading documents, and taking a verdict on rows back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.durable import broadcast_if_small, durable
from millrace.plans.spread import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def row_tag() -> Column:
    """With the id, what tells a row from others: a hash of its text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def staying(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged(doc_id, tag, stays)``, a row for each, lets stay; of equal ones that stay, one.

    Only the rows that go are looked up, so the texts are not shuffled unless very many of them do.
    """
    judged = durable(judged.select("doc_id", "tag", "stays"))
    gone = durable(judged.filter("not stays").select(F.col("doc_id").alias("i"), F.col("tag").alias("t")).distinct())
    again = durable(judged.filter("stays").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("i"), F.col("tag").alias("t")))
    here = docs.withColumn("row_tag_", row_tag())
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_tag_") == F.col("t"))
    left = here.join(broadcast_if_small(gone, 200_000), same, "left_anti")
    if again.limit(1).count():
        again = broadcast_if_small(again, 200_000)
        order = Window.partitionBy("doc_id", "row_tag_").orderBy(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.length("text"))
        one = left.join(again, same, "left_semi").withColumn("row_n_", F.row_number().over(order)).filter("row_n_ = 1").drop("row_n_")
        left = left.join(again, same, "left_anti").unionByName(one)
    return left.select(*docs.columns)

"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words; a document of the source is wanted target / size-of-source times.
The whole part of that is taken as certain copies. The fraction is an inclusion probability p, and the
extra copies are drawn by Pareto order sampling (Rosén, 1997): a document's uniform number u gives the rank
(u / (1 - u)) / (p / (1 - p)), and each source takes its lowest ranks up to the words still wanted, so
the sample's size is fixed. ``weight_col`` makes probabilities within a source unequal.

u comes from the MD5 of seed and id, so reruns agree. Shares: sources by code point, null last, weigh 1, 2,
3, repeating, unless ``weights`` gives others; a target stops at ``most`` times the source, and the excess
is shared again by weight (found in closed form: sources by size per weight, then one level for those below their stop).

Defined results: a null text has no words and is taken with 0; a null source is a source; null and repeated
ids are rows as others (equal ids share their u; ties go by size); other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.cut import take_until
from millrace.llm.rows import documents, row_tag
from millrace.plans.durable import broadcast_if_small, durable

BUCKETS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _uniform(col: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``. One row per source is all that its windows see."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    stops = ranked.withColumn("w", weight).withColumn("stop", most * F.col("source_size"))
    rising = Window.orderBy((F.col("stop").cast("double") / F.col("w")), "i")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - (F.sum("stop").over(rising) - F.col("stop"))).cast("double") / (F.sum("w").over(every) - F.sum("w").over(rising) + F.col("w"))
    levels = stops.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("level"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("stop").cast("double") / F.col("w"), "i"))).over(every)
    return levels.withColumn("share", level).select("source", "source_size", F.least(F.col("stop").cast("double"), F.col("w") * F.col("share")).alias("target"))


def mix(docs: DataFrame, seed: int = 11, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), weight_col: str | None = None) -> DataFrame:
    """``doc_id, source, tag, size, source_size, target, copies`` for every row; the mix takes the whole text ``copies`` times.

    ``weight_col`` (positive; null and others count as 0): wanted copies are in proportion to it within the
    source, stopping at ``most``; what stops there is not shared again.
    """
    own = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.nanvl(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = durable(docs.select("doc_id", "source", row_tag().alias("tag"), words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), seed).alias("u"), own.alias("own")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("own") * F.col("size")).cast("decimal(38,6)")).cast("double").alias("own_size"))
    sums = durable(sums)
    shares = targets(sums.select("source", "source_size"), most, weights).withColumnRenamed("source", "named")
    shares = shares.join(sums.select(F.col("source").alias("s2"), "own_size"), F.col("named").eqNullSafe(F.col("s2"))).drop("s2")
    shares = broadcast_if_small(durable(shares), 100_000)
    wanted = F.least(F.when(F.col("own_size") > 0, F.col("target") / F.col("own_size") * F.col("own")).otherwise(0.0), F.lit(float(most)))
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("named"))).withColumn("wanted", wanted)
    p = F.col("wanted") - F.floor("wanted")
    rows = rows.withColumn("sure", F.floor("wanted")).withColumn("p", p)
    odds = F.col("u") / (1 - F.col("u"))
    rank = F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))).otherwise(F.lit(float("inf")))
    # ranks times the odds of the source's mean probability are near u's own odds, which spreads the buckets evenly
    mean = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    mean = mean - F.floor(mean)
    even = F.when((mean > 0) & (mean < 1), mean / (1 - mean)).otherwise(1.0)
    bucket = F.floor((1 - 1 / (1 + F.col("rank") * even)) * BUCKETS)
    rows = rows.withColumn("rank", rank).withColumn("bucket", bucket)
    if weight_col is None:
        rows = rows.withColumn("budget", F.col("target") - F.floor(mean_copies()) * F.col("source_size"))
    else:
        rows = durable(rows)
        left = rows.groupBy("source").agg(F.sum((F.col("p") * F.col("size")).cast("decimal(38,6)")).cast("double").alias("budget"))
        left = broadcast_if_small(durable(left.withColumnRenamed("source", "s2")), 100_000)
        rows = rows.join(left, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    picked = take_until(rows, "source", [F.col("rank"), F.col("doc_id").asc_nulls_last(), F.col("size")], "bucket", "size", "budget")
    extra = (F.col("picked") & (F.col("p") > 0)).cast("long")
    return picked.select("doc_id", "source", "tag", "size", "source_size", "target", (F.col("sure") + extra).alias("copies"))


def mean_copies() -> Column:
    """Copies wanted of each document where weights are equal."""
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source
), l AS (
  SELECT *, 3 * source_size AS stop, (sum(source_size) OVER () - (sum(3 * source_size) OVER r - 3 * source_size))::DOUBLE / (sum(w) OVER () - sum(w) OVER r + w)::DOUBLE AS level
  FROM s WINDOW r AS (ORDER BY (3 * source_size)::DOUBLE / w, i ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(stop::DOUBLE, w * (SELECT arg_min(level, (stop::DOUBLE / w, i)) FROM l WHERE level * w <= stop)) AS target FROM l
), c AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS wanted
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, wanted - floor(wanted) AS p FROM c
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'inf'::DOUBLE END AS rank FROM p
)
SELECT doc_id, size, source_size, target, (size * (floor(wanted) + CASE WHEN p > 0 AND
    2 * sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size <= 2 * (target - floor(wanted) * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""

"""Relational helpers: explode, sample, strata, casts, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.durable import broadcast_if_small, durable
from millrace.plans.registry import operator


@operator("explode", "table")
def explode(df: DataFrame, field: str, exploded_cols: list[str]) -> DataFrame:
    """A row for each element (one name) or entry (two names); null and empty collections give none.

    Those are dropped afterwards: Spark's own ``explode`` asks for the collection's size first, and so computes a costly one twice.
    """
    return df.select("*", F.posexplode_outer(F.col(f"`{field}`")).alias("position_", *exploded_cols)).filter("position_ IS NOT NULL").drop("position_")


def _order(df: DataFrame, seed: int):
    """A repeatable random order of rows by their content."""
    plain = [F.col(f"`{f.name}`") if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(F.col(f"`{f.name}`")) for f in df.schema]
    return F.xxhash64(F.lit(seed), *plain)


@operator("sample", "table")
def sample(df: DataFrame, sample: int | float, seed: int = 777) -> DataFrame:
    """A whole number: exactly so many rows (all, if there are fewer); a fraction: each row with that chance."""
    if isinstance(sample, bool) or sample < 0 or isinstance(sample, float) and sample > 1:
        raise ValueError("sample must be a number of rows or a fraction from 0.0 to 1.0")
    if isinstance(sample, float):
        return df.sample(fraction=sample, seed=seed)
    # the cut lies in one of 4096 ranges of the order; those below are taken whole, so that nothing is gathered in one task
    order = _order(df, seed)
    part = F.shiftrightunsigned(order, 52)
    counts = sorted(df.groupBy(part.alias("part_")).count().collect())
    left, cut = sample, 4096
    for number, n in counts:
        if n >= left:
            cut = number
            break
        left -= n
    return df.filter(part < cut).unionByName(df.filter(part == cut).orderBy(order).limit(left))


@operator("stratified_sampler", "table")
def stratified_sampler(df: DataFrame, strata_column: str, samples_per_stratum: int = 100, seed: int = 777) -> DataFrame:
    """At most so many rows of each stratum, null being one, in a repeatable random order.

    Few samples: Spark prunes them in each task, before the shuffle. More than it does that for
    (``spark.sql.optimizer.windowGroupLimitThreshold``): the cut of each stratum lies in one of 4096 ranges of the order; those below it are
    taken whole, so that no stratum is gathered in one task.
    """
    if strata_column not in df.columns:
        raise ValueError(f"there is no column {strata_column!r}")
    stratum, order = F.col(f"`{strata_column}`"), _order(df, seed)
    w = Window.partitionBy(f"`{strata_column}`").orderBy(order)
    number = F.row_number().over(w)
    if samples_per_stratum <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df.withColumn("stratum_row_", number).filter(F.col("stratum_row_") <= samples_per_stratum).drop("stratum_row_")
    part = F.shiftright(order, 52)
    counts = df.groupBy(stratum.alias("stratum_"), part.alias("part_")).agg(F.count("*").alias("n_"))
    upto = Window.partitionBy("stratum_").orderBy("part_")
    ends = counts.withColumn("end_", F.sum("n_").over(upto)).filter(F.col("end_") > samples_per_stratum)
    cut = ends.groupBy("stratum_").agg(F.min("part_").alias("cut_"), F.min(F.col("end_") - F.col("n_")).alias("before_"))
    cut = broadcast_if_small(durable(cut), 100_000)
    met = df.withColumn("part_", part).join(cut, stratum.eqNullSafe(F.col("stratum_")), "left")
    below = met.filter(F.col("cut_").isNull() | (F.col("part_") < F.col("cut_"))).select(*(F.col(f"`{c}`") for c in df.columns))
    at_cut = met.filter(F.col("part_") == F.col("cut_")).withColumn("stratum_row_", number).filter(F.col("stratum_row_") + F.col("before_") <= samples_per_stratum)
    return below.unionByName(at_cut.select(*(F.col(f"`{c}`") for c in df.columns)))


#: Names of types that columns can be cast to.
TYPES = {
    "string": "string", "str": "string", "integer": "int", "int": "int", "long": "bigint", "bigint": "bigint", "float": "float", "double": "double",
    "decimal": "decimal(10,0)", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "binary": "binary",
}


@operator("field_type_converter", "table")
def field_type_converter(df: DataFrame, field_type_mapping: dict[str, str]) -> DataFrame:
    """Casts in place; values that do not fit become null, columns that are not there are passed over."""
    unknown = [t for t in field_type_mapping.values() if t.lower() not in TYPES]
    if unknown:
        raise ValueError(f"unknown type {unknown[0]!r}")
    cast = lambda c: F.col(f"`{c}`").try_cast(TYPES[field_type_mapping[c].lower()]).alias(c) if c in field_type_mapping else F.col(f"`{c}`")
    return df.select(*map(cast, df.columns))


@operator("spark_sql_executor", "sql")
def spark_sql_executor(spark: SparkSession, inputs: dict[str, DataFrame], sql_query: str) -> DataFrame:
    """A query over views and catalog tables; ``{name}`` in it stands for the frame of that name."""
    used = {k: v for k, v in inputs.items() if k and "{" + k + "}" in sql_query}
    return spark.sql(sql_query, **used) if used else spark.sql(sql_query)

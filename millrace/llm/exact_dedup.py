"""Exact dedup of incoming documents against immutable snapshots.

A snapshot is a table of classes (digest, normalised length, rows, the row that stays) and, per
digest shard, one static binary-fuse filter; neither changes once written. Incoming rows are first
grouped among themselves by digest (map-side combined, so a huge group of copies is a count);
then the filters screen one row per distinct digest, and only the positives are joined with the
snapshot's buckets. Every class that ends with two or more rows is then checked byte by byte:
the least and the greatest normalised text of the class must be the same. A digest that two
different texts share fails the job instead of merging them.

Equality: texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].
The row with the most code points stays, then the smallest doc_id; null ids come last.

Defined results: a null text is empty; rows that repeat (even with their id) are rows of their
group, and those that repeat the id of the row that stays are all marked ``kept``; a null doc_id
is an id like any other but loses every tie; other columns are ignored, whatever their names;
an empty table or snapshot gives no rows or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import binary_fuse
from millrace.llm.rows import documents, row_tag, staying
from millrace.plans.durable import broadcast_if_small, discard, durable

KEY = ["sha", "norm_len"]
#: Rows of a side that may be broadcast; beyond it the join shuffles.
SMALL = 200_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, sha, norm_len, best`` for each row; the greatest ``best`` of a class is the row that stays."""
    norm = normalised(F.col("text"))
    best = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.bitwise_not("doc_id").alias("inv_id"))
    return docs.select("doc_id", row_tag().alias("tag"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"), F.octet_length(norm).alias("norm_len"), best.alias("best"))


def classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("best").alias("best"))


def _key64(df: DataFrame, shards: int) -> DataFrame:
    k = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    return df.withColumn("k", k).withColumn("shard", F.pmod(F.col("k"), F.lit(shards)).cast("int"))


class Snapshot:
    """Classes and filters of documents already taken in, both durable."""

    def __init__(self, rows: DataFrame, shard_keys: int = 200_000):
        self.classes = durable(classes(rows))
        self.shard_keys = shard_keys
        self.shards = max(1, -(-self.classes.count() // shard_keys))

        def build(key, table):
            blob = binary_fuse.build(np.asarray(table.column("k")).astype(np.uint64))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([blob], pa.binary())})

        keys = _key64(self.classes, self.shards).select("shard", "k")
        self.filters = durable(keys.groupBy("shard").applyInArrow(build, "shard int, filter binary"))

    def screen(self, incoming: DataFrame) -> DataFrame:
        """``incoming`` classes with ``maybe``: false where the digest is surely not in the snapshot.

        Where a shard meets more than ``shard_keys`` digests, these are dealt to several tasks, each with a copy of its filter.
        """
        parts = max(1, -(-incoming.count() // (self.shards * self.shard_keys)))

        def probe(key, new, filters):
            hit = np.zeros(new.num_rows, bool)
            for blob in filters.column("filter").to_pylist():
                hit |= binary_fuse.maybe_contains(blob, np.asarray(new.column("k")).astype(np.uint64))
            return pa.table({"sha": new.column("sha"), "norm_len": new.column("norm_len"), "maybe": pa.array(hit)})

        part = F.pmod(F.shiftright("k", 40), F.lit(parts)).cast("int").alias("part")
        keyed = _key64(incoming, self.shards).select("shard", part, "k", *KEY)
        copies = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        flags = keyed.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, "sha binary, norm_len int, maybe boolean")
        return incoming.join(flags, KEY)


def _check_bytes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``sha`` of each class of two or more rows, after comparing its texts; fails where they differ."""
    norm = normalised(F.col("text"))
    texts = docs.select(norm.alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    texts = texts.join(broadcast_if_small(repeated.select("sha"), SMALL), "sha", "left_semi")
    ends = texts.groupBy("sha").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    differ = F.raise_error(F.lit("two different texts have one SHA-256 digest")).cast("string")
    return ends.select("sha", F.when(F.col("a") == F.col("b"), F.lit("same")).otherwise(differ).alias("checked"))


def exact_dedup(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every row of both: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``tag, stays`` for ``staying``.

    ``known`` is the earlier batch, made into a snapshot; ``incoming`` the new one. Either may be empty.
    """
    docs = known.select("doc_id", "text").unionByName(incoming.select("doc_id", "text"))
    old, new = durable(digests(known)), durable(digests(incoming))
    snapshot = Snapshot(old)
    screened = durable(snapshot.screen(durable(classes(new))))
    hits = screened.filter("maybe").select(*KEY, F.col("n").alias("n2"), F.col("best").alias("best2"))
    met = snapshot.classes.join(hits, KEY, "full_outer").select(
        *KEY,
        (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"),
        F.greatest("best", "best2").alias("best"),
    )
    every = durable(met.unionByName(screened.filter("not maybe").select(*KEY, "n", "best")))
    repeated = durable(_check_bytes(docs, every.filter("n > 1")))
    # ids outside the repeated classes are their own; those inside look their class up
    found = every.filter("n > 1").join(repeated, "sha").select(*KEY, "n", F.bitwise_not("best.inv_id").alias("keep_id"), F.col("best").alias("class_best"))
    found = durable(found)
    discard(screened, every, repeated, snapshot.classes, snapshot.filters)
    rows = old.unionByName(new).join(broadcast_if_small(found, SMALL), KEY, "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "tag",
        (F.col("n").isNull() | F.col("best").eqNullSafe(F.col("class_best"))).alias("stays"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class of equal texts."""
    first = first_batch(docs)
    return staying(docs, exact_dedup(docs.filter(first), docs.filter(~first)))


def first_batch(docs: DataFrame) -> Column:
    """The split into two batches that the query and the pipeline make of one table: by the id's checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 2 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, taken in as two batches: the first becomes the snapshot, the second is screened against it."""
    docs = documents(spark, sf_dir)
    return exact_dedup(docs.filter(first_batch(docs)), docs.filter(~first_batch(docs))).drop("tag", "stays")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

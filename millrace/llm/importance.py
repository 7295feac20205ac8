"""Quality selection by importance resampling (Xie et al., 2023).

A text is a bag of hashed word unigrams and bigrams (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). Two generative models
of that bag are counted, of the target texts and of the raw corpus, over ``buckets`` hash buckets; a
document's log importance weight is the sum of log(target / raw) over its features. Adding Gumbel noise and taking the
k greatest sums is a sample without replacement in proportion to the weights.

Both models are arrays of ``buckets`` sums, whatever the corpus, so they may be gathered and broadcast. The noise comes from
the MD5 of seed and id: reruns agree. The cut at k is exact, from sums over buckets of the key.

Defined results: a null text has no features and weight 0, like an empty one; null and repeated ids are rows as others (equal
ids share their noise, ties go by id); labels of unknown documents count for nothing; without target
texts both models are flat and the sample is uniform; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.cut import take_until
from millrace.llm.rows import documents
from millrace.plans.durable import broadcast_if_small, durable

SLICE = 1000


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts one after another, and where each text's begin (with the end at last)."""
    words = [t.lower().split() for t in texts]  # of bytes: exactly the six ASCII blanks, and A-Z only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.fromiter((zlib.crc32(w) for ws in words for w in ws), np.uint64, int(starts[-1]))
    odd = np.uint64(0x9E3779B97F4A7C15)
    pairs = (hashes[:-1] * np.uint64(31) + hashes[1:] + np.uint64(1)) * odd if len(hashes) else hashes
    top = np.uint64(33)
    both = np.zeros(2 * len(hashes), np.int64)
    both[::2] = ((hashes * odd) >> top) % np.uint64(buckets)
    both[1:-1:2] = (pairs >> top) % np.uint64(buckets)
    keep = np.ones(len(both), bool)
    keep[2 * starts[1:][sizes > 0] - 1] = False  # no pair reaches over a text's last word
    return both[keep], np.concatenate([[0], np.cumsum(np.maximum(2 * sizes - 1, 0))])


def _slices(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            yield b, [t.as_buffer().to_pybytes() for t in b.column(column)]


def _text():
    return F.coalesce("text", F.lit("")).cast("binary").alias("__text")


def feature_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``docs``: every task sends one row for each bucket that it met."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for _, texts in _slices(batches, 0):
            sums += np.bincount(features(texts, buckets)[0], minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    rows = docs.select(_text()).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = ((x + smoothing) / (x.sum() + smoothing * len(x)) for x in (target, raw))
    return np.log(p / q) if target.sum() else np.zeros(len(target))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, n_features, log_weight`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b, texts in _slices(batches, 1):
            found, starts = features(texts, len(sent.value))
            sizes = np.diff(starts)
            # each text's sum by itself, whatever else is in the batch
            sums = np.bincount(np.repeat(np.arange(len(texts)), sizes), sent.value[found], minlength=len(texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(sums)], names=["doc_id", "n_features", "log_weight"])

    return docs.select("doc_id", _text()).mapInArrow(run, f"doc_id {kind}, n_features long, log_weight double")


def resample(docs: DataFrame, target: DataFrame, share: float = 0.8, buckets: int = 10_000, seed: int = 5) -> DataFrame:
    """``doc_id, n_features, log_weight, key, selected``: ``selected`` marks the ceil(share * rows) greatest keys."""
    ratios = log_ratios(feature_counts(target, buckets), feature_counts(docs, buckets))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    rows = durable(weigh(docs, ratios).withColumn("key", F.col("log_weight") - F.log(-F.log(u))).withColumn("all", F.lit(0)))
    k = int(np.ceil(share * rows.count()))
    # a whole number that falls as the key grows, at most some 90,000 of them over all doubles that occur
    size = F.floor(F.log1p(F.abs("key")) * 2048)
    rows = rows.withColumn("bucket", F.when(F.col("key") > 0, -size).otherwise(size)).withColumn("one", F.lit(1)).withColumn("k", F.lit(k))
    picked = take_until(rows, "all", [F.desc("key"), F.col("doc_id").asc_nulls_last()], "bucket", "one", "k")
    return picked.select("doc_id", "n_features", "log_weight", "key", F.col("picked").alias("selected"))


def labelled_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``labels(doc_id, quality, toxic)`` calls good and not toxic."""
    good = labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct()
    return docs.select("doc_id", "text").join(broadcast_if_small(durable(good), 200_000), "doc_id", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labelled_good(docs, labels))

"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles of four words
(repeats included, joined by one space; fewer words: the whole sequence; none: fingerprint zero), XXH64 with
seed 42 of each; a bit is 1 if set in over half of the hashes.

Search: Pagh's covering scheme (2016). Each of the 64 bit positions gets a vector of r+1 bits; for
each of the 2^(r+1)-1 non-zero vectors v, table v keeps the positions whose vector has an odd product
with v. For any r positions some non-zero v is orthogonal to all of their vectors, so two
fingerprints that differ in at most r bits agree in that table: no pair is missed.

Links are made between distinct fingerprints only. In a bucket, a breadth-first search over exact
distances emits one link for each fingerprint that it reaches, never all pairs. Buckets of more than
``block`` fingerprints are dealt as pairs of blocks over many tasks, so none has to fit one.

Defined results: a null text is empty; documents without words link with each other and with whatever is
within the radius of zero; repeated rows are rows of their class; component_id is the smallest non-null id
reachable (null where there is none); other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.rows import documents, row_tag
from millrace.plans.components import connected_components
from millrace.plans.durable import broadcast_if_small, durable

BITS = 64


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle of ``words``, of which there is one at least."""
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter([hash64(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 4096):  # the bits of so many hashes at once
        part = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # of bytes: exactly the six ASCII blanks, and A-Z only
    return majority(shingle_hashes(words, shingle)) if words else 0


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``tag`` of the row and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            prints = np.array([_fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "tag", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_tag().alias("tag"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, tag long, fp long")


def masks(radius: int) -> list[int]:
    """The masks of the tables, as signed longs. Positions' vectors go round all non-zero ones, so every table keeps 31 to 36 of 64 bits at radius 4."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    found = [sum((bin(x & v).count("1") & 1) << i for i, x in enumerate(vectors)) for v in range(1, 2 ** (radius + 1))]
    return [m - 2**64 if m >= 2**63 else m for m in found]


def _reach(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is joined by distances of at most ``radius``: a search tree for each component."""
    left, links = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(np.bitwise_xor(left, x)) <= radius
            if near.any():
                got = left[near]
                links += [(int(y), int(x)) for y in got]
                front += list(got)
                left = left[~near]
    return links


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = 20_000) -> DataFrame:
    """Links ``u, v`` between the distinct values of ``fps(fp)`` that keep what distances up to ``radius`` connect."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])).alias("b")
    entries = fps.select("fp", tables).select("fp", "b.t", "b.key")
    sizes = durable(entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = entries.join(broadcast_if_small(sizes, 200_000), ["t", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    dealt = (
        shared.withColumn("nb", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("fp", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    keys = ["t", "key", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, last = [], None

        def links():
            found = _reach(np.unique(np.concatenate(held)), radius) if held else []
            return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c) for c in b.columns]
            new = np.zeros(b.num_rows, bool)
            for c in cols[1:]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(c[a]) for c in cols[1:])
                if key != last:
                    if held and sum(map(len, held)) > 1:
                        yield links()
                    held, last = [], key
                held.append(cols[0][a:z])
        if held:
            yield links()

    return dealt.mapInArrow(run, "u long, v long").distinct()


def simhash_dedup(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``doc_id, tag, fp, component_id, component_fp`` for every row of ``docs``; the last is the class's own key, which is never null."""
    rows = durable(fingerprints(docs, shingle))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component_fp", F.coalesce("component", "fp"))
    ids = named.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    classes = broadcast_if_small(durable(named.join(ids, "component_fp").select("fp", "component_fp", "component_id")), 200_000)
    return rows.join(classes, "fp").select("doc_id", "tag", "fp", "component_id", "component_fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

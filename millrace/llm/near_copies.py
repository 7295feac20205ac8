"""Near copies by the similarity of their word shingles, compared exactly.

Words are those of SimHash; texts with the same words are one node. Two nodes are linked if the Jaccard similarity of
their sets of shingles (five words; fewer words: the whole sequence) is at least 0.8. Candidates share a bucket: of one
of the covering tables of the SimHash fingerprints at radius 4, or of one of 20 bands of four MinHash values. A pair of
similarity 0.8 differs in some ten of the 64 bits, for which covering tables would be thousands, so the bands are what
reaches it: they miss 3 in 100,000 pairs at 0.8 and fewer above.

Each bucket is searched for what links reach, on the sets themselves, so no candidate counts unchecked. Buckets with the
same nodes are searched once. One of more than ``block`` nodes is first searched in chunks; where its nodes are not all
joined by then, those outside its largest component are compared with each other and with every chunk of that.

Defined results: a null text is empty; texts without words are one node; of each component the row of the smallest id
stays (null last); an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.rows import row_tag, staying
from millrace.llm.simhash import majority, masks, shingle_hashes
from millrace.plans.components import connected_components
from millrace.plans.durable import broadcast_if_small, discard, durable

BANDS, WIDTH = 20, 4


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(19980731)
    return tuple(rng.integers(0, 2**64, BANDS * WIDTH, np.uint64, endpoint=False) for _ in range(2))


def _keys(hashes: np.ndarray, tables: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bucket in each covering table, then in each band."""
    low = hashes & np.uint64(2**32 - 1)
    least = np.full(BANDS * WIDTH, 2**32 - 1, np.uint64)
    for at in range(0, len(low), 256):  # multiply-shift hashing, as in the MinHash operator
        least = np.minimum(least, ((low[at : at + 256, None] * a + c) >> np.uint64(32)).min(axis=0))
    bands = [xxhash.xxh64_intdigest(least[i : i + WIDTH].tobytes(), i) for i in range(0, BANDS * WIDTH, WIDTH)]
    return np.concatenate([np.uint64(majority(hashes)) & tables, np.array(bands, np.uint64)]).view(np.int64)


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, tag, node, keys`` of every row; the keys are empty where there are no words."""

    def run(batches):
        tables, (a, c) = np.array([m % 2**64 for m in masks(4)], np.uint64), _permutations()
        for b in batches:
            nodes, keys = [], []
            for t in b.column(2):
                words = t.as_buffer().to_pybytes().lower().split()
                nodes.append(hashlib.md5(b" ".join(words)).digest())
                keys.append(_keys(shingle_hashes(words, shingle), tables, a, c) if words else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tag", "node", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", row_tag().alias("tag"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, tag long, node binary, keys array<long>")


def _reach(nodes: list[bytes], sets: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join what is joined by ``similarity`` or more: a search tree for each component."""
    size, links = np.array([len(s) for s in sets]), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    open_ = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first], front = False, [first]
        while front and open_.any():
            x = front.pop()
            at = np.searchsorted(sets[x], flat)
            both = np.bincount(owner[sets[x][np.minimum(at, size[x] - 1)] == flat], minlength=len(sets))
            got = np.flatnonzero(open_ & (both >= similarity * (size + size[x] - both) - 1e-9))
            if len(got):
                links += [(nodes[y], nodes[x]) for y in got]
                front += got.tolist()
                open_[got] = False
                left = open_[owner]
                flat, owner = flat[left], owner[left]
    return links


def _links(units: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``u, v`` within each unit of ``units(node, t, key, i, j)``."""
    by = ["t", "key", "i", "j"]
    dealt = units.join(texts, "node").select("node", "text", *by).repartition(*by).sortWithinPartitions(*by)

    def run(batches):
        held, last = {}, None

        def links():
            found = _reach(list(held), list(held.values()), similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            keys = zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)
            for node, text, key in zip(b.column(0), b.column(1), keys, strict=True):
                if key != last:
                    yield links()
                    held, last = {}, key
                if (name := node.as_py()) not in held:
                    held[name] = np.unique(shingle_hashes(text.as_buffer().to_pybytes().lower().split(), shingle))
        yield links()

    return dealt.mapInArrow(run, "u binary, v binary").distinct()


def _unjoined(shared: DataFrame, links: DataFrame, block: int) -> DataFrame | None:
    """Units of what the chunks of large buckets left unjoined; None if there is none."""
    large = shared.filter(F.col("n") > block)
    if not large.limit(1).count():
        return None
    parts = broadcast_if_small(durable(connected_components(links)), 200_000)
    large = durable(large.join(parts, "node", "left").select("node", "t", "key", F.coalesce("component", "node").alias("part")))
    sizes = large.groupBy("t", "key", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("t", "key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("all")).filter("main.n < all")
    count = lambda n: F.ceil(n / block).cast("int")
    sizes = durable(sizes.select("t", "key", "main.part", count(F.col("main.n")).alias("chunks"), count(F.col("all") - F.col("main.n")).alias("rests")).withColumnRenamed("part", "main"))
    large = large.join(broadcast_if_small(sizes, 200_000), ["t", "key"])
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # unit i, j: block i of the rest with chunk j of the main component, or with block -1 - j of the rest
    main = large.filter("part = main").withColumn("j", mine("chunks")).withColumn("i", F.explode(to("rests")))
    rest = large.filter("part <> main").withColumn("mine", mine("rests"))
    across = rest.withColumn("i", F.col("mine")).withColumn("j", F.explode(to("chunks")))
    within = rest.withColumn("other", F.explode(to("rests"))).withColumn("i", F.least("mine", "other")).withColumn("j", -1 - F.greatest("mine", "other"))
    columns = ["node", "t", "key", "i", "j"]
    return main.select(*columns).unionByName(across.select(*columns)).unionByName(within.select(*columns))


def near_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """Links ``u, v`` that keep what the similarity connects of ``nodes(node, row, keys)``, ``row`` being that of its text."""
    entries = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("n"), *same).filter("n > 1")
    sizes = durable(sizes.groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select("n", "b.t", "b.key"))
    shared = durable(entries.join(broadcast_if_small(sizes, 200_000), ["t", "key"]))
    wanted = durable(nodes.join(broadcast_if_small(shared.select("node").distinct(), 200_000), "node", "left_semi").select("node", F.col("row.doc_id").alias("i"), F.col("row.tag").alias("g")))
    here = F.col("doc_id").eqNullSafe(F.col("i")) & (row_tag() == F.col("g"))
    texts = durable(docs.join(broadcast_if_small(wanted, 200_000), here).select("node", F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    chunk = F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / block)).cast("int")
    links = durable(_links(shared.select("node", "t", "key", chunk.alias("i"), F.lit(0).alias("j")), texts, shingle, similarity))
    more = _unjoined(shared, links, block)
    out = links if more is None else durable(links.unionByName(_links(more, texts, shingle, similarity)).distinct())
    discard(shared, wanted, texts)
    return out


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 500) -> DataFrame:
    """The rows of ``docs``, all columns, that stay."""
    rows = durable(_rows(docs, shingle))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    nodes = durable(rows.groupBy("node").agg(F.min(own).alias("row"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    parts = broadcast_if_small(durable(connected_components(near_links(docs, nodes, shingle, similarity, block))), 200_000)
    named = nodes.select("node", "row", "n").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    best = named.groupBy("part").agg(F.min("row").alias("best"), F.sum("n").alias("all")).filter("all > 1")
    of = named.join(broadcast_if_small(durable(best), 200_000), "part").select("node", "best")
    judged = rows.select("doc_id", "tag", "node").join(broadcast_if_small(durable(of), 200_000), "node", "left")
    return staying(docs, judged.select("doc_id", "tag", (F.col("best").isNull() | own.eqNullSafe(F.col("best"))).alias("stays")))

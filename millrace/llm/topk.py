"""Exact top-k inner-product search by a three-phase uniform threshold (Cao and Wang, 2004).

Vectors become whole numbers, floor(256 x) of each component, and are cut into ``slices`` of dimensions; a
score is the sum of one local score per slice.
1. Gather: every block of vectors gives, for each query and slice, its list of the best local scores, and those
   entries' totals. The k-th best total found for a query is a safe cutoff T: the answer's scores are no lower.
2. The cutoff goes back to the blocks with the query. An entry that totals T or more has a local score of at least T / slices
   somewhere, so the entries above that line in some slice are sufficient.
3. Their remaining local scores are added, exactly, and those below T go.

Equal vectors are searched once: a class keeps its k + 1 smallest ids, which is all that an answer can hold of it.
Queries meet rows in blocks: a block of vectors is sent once for each block of queries, and nothing is broadcast.

Defined results: vectors null or with null or non-finite components, and rows with a null id, take no part; shorter
vectors count as padded with zeros; a row repeated with its id is one candidate, and an id with two vectors is a
candidate by each of them; components and scores beyond a long count as the greatest or least long, all others are exact; a query never finds its own id; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.durable import durable


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec array<long>, cls`` of the rows that take part; equal vectors have equal ``cls``."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(id_col).isNotNull()
    vec = F.transform(x, lambda v: F.floor(v * 256))
    rows = table.filter(fine).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    trimmed = F.slice("vec", 1, F.coalesce(F.array_max(F.filter(F.transform("vec", lambda v, i: F.when(v != 0, i + 1)), lambda i: i.isNotNull())), F.lit(0)))
    return rows.withColumn("vec", trimmed).withColumn("cls", F.unhex(F.sha2(F.array_join("vec", ",").cast("binary"), 256)))


#: Scores are given as longs; those beyond count as the greatest or the least of these.
MOST = 2**63 - 1


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows padded to ``dims``."""
    out = np.zeros((len(column), dims), np.int64)
    flat = column.combine_chunks()
    sizes = np.diff(np.asarray(flat.offsets))
    out[np.arange(dims) < sizes[:, None]] = np.asarray(flat.flatten())
    return out


def _sizes(m: np.ndarray) -> np.ndarray:
    """The greatest absolute value of each row, as a double no smaller than it."""
    return np.nextafter(np.abs(m.astype(np.float64)).max(axis=1, initial=0), np.inf)


def _beyond(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of vectors whose products may pass 2^63: whole numbers of any length where they do, brought into the longs."""
    line = np.sqrt(2.0**62 / max(q.shape[1], 1))
    large_q, large_c = _sizes(q) >= line, _sizes(c) >= line
    out = np.zeros((len(q), len(c)), np.int64)
    out[np.ix_(~large_q, ~large_c)] = q[~large_q] @ c[~large_c].T
    for rows, columns in ((large_q, np.ones(len(c), bool)), (~large_q, large_c)):
        if rows.any() and columns.any():
            exact = q[rows].astype(object) @ c[columns].T.astype(object)
            out[np.ix_(rows, columns)] = np.clip(exact, -MOST, MOST).astype(np.int64)
    return out


def _scorer(q: np.ndarray, c: np.ndarray, slices: int):
    """A function that gives the local scores of queries from..to by slice, exactly: by doubles below 2^53, by longs below 2^63, else as one slice."""
    reach = _sizes(q).max(initial=0) * _sizes(c).max(initial=0) * max(q.shape[1], 1)
    if reach >= 2.0**62:
        return lambda a, z: [_beyond(q[a:z], c)]
    if reach < 2.0**52:
        q, c = q.astype(np.float64), c.astype(np.float64)
    cuts = np.linspace(0, q.shape[1], slices + 1).astype(int)
    return lambda a, z: [q[a:z, i:j] @ c[:, i:j].T for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _search(k: int, slices: int, dims: int):
    """The function for both passes over a pair of blocks; without ``cutoff`` among the queries' columns it is the first."""

    def run(key, queries, corpus):
        out = {"query": [], "cls": [], "score": [], "least": []}
        names, ids = corpus.column("cls"), np.asarray(corpus.column("least"))
        c, q = _matrix(corpus.column("vec"), dims), _matrix(queries.column("vec"), dims)
        cutoffs = np.asarray(queries.column("cutoff")) if "cutoff" in queries.column_names else None
        step, local = max(1, 2_000_000 // max(len(c), 1)), _scorer(q, c, slices)
        for at in range(0, len(q) if len(c) else 0, step):
            parts = local(at, at + step)
            for i in range(len(parts[0])):
                if cutoffs is None:
                    found = np.unique(np.concatenate([np.argpartition(-p[i], min(k, len(c)) - 1)[:k] for p in parts]))
                else:
                    line = int(cutoffs[at + i]) // len(parts)
                    found = np.flatnonzero(np.logical_or.reduce([p[i] >= line for p in parts]))
                total = sum(p[i][found] for p in parts)
                if cutoffs is not None:
                    found, total = found[total >= cutoffs[at + i]], total[total >= cutoffs[at + i]]
                best = np.lexsort((ids[found], -total))[:k]
                out["query"] += [at + i] * len(best)
                out["cls"] += found[best].tolist()
                out["score"] += total[best].astype(np.int64).tolist()
                out["least"] += ids[found[best]].tolist()
        return pa.table({
            "query": queries.column("cls").take(pa.array(out["query"], pa.int64())),
            "cls": names.take(pa.array(out["cls"], pa.int64())),
            "score": pa.array(np.array(out["score"], np.int64)),
            "least": pa.array(out["least"], pa.int64()),
        })

    return run


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, slices: int = 2, block: int = 16_384, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` (rows of ``table``'s kind), the ``k`` best other rows of ``table``."""
    need = k + 1
    rows = durable(whole_vectors(table, id_col, vector_col))
    asked = durable(whole_vectors(queries, id_col, vector_col))
    by_id = Window.partitionBy("cls").orderBy("id")
    unique = rows.groupBy("cls", "id").agg(F.first("vec").alias("vec"))
    first_ids = unique.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= need)
    corpus = durable(first_ids.groupBy("cls").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("ids")))
    wanted = durable(asked.groupBy("cls").agg(F.first("vec").alias("vec")))
    n, n_asked = corpus.count(), wanted.count()
    dims = max(f.agg(F.max(F.size("vec"))).first()[0] or 0 for f in (corpus, wanted))
    # a block's matrix stays within 64 MB, however many dimensions there are
    block, query_block = (max(1, min(b, (8 << 20) // max(dims, 1))) for b in (block, query_block))
    n_c, n_q = max(1, -(-n // block)), max(1, -(-n_asked // query_block))
    here = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q")
    blocks = corpus.select("cls", "vec", "least", F.pmod(F.xxhash64("cls"), F.lit(n_c)).cast("int").alias("c"), here).groupBy("q", "c")

    def against(queries: DataFrame, *more: str) -> DataFrame:
        there = F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c")
        dealt = queries.select("cls", "vec", *more, F.pmod(F.xxhash64("cls"), F.lit(n_q)).cast("int").alias("q"), there)
        return dealt.groupBy("q", "c").cogroup(blocks).applyInArrow(_search(need, slices, dims), "query binary, cls binary, score long, least long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    gathered = against(wanted).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need)
    cutoffs = gathered.groupBy("query").agg(F.when(F.count("*") == need, F.min("score")).alias("cutoff"))
    lowest = F.lit(-MOST).cast("long")
    told = durable(wanted.join(cutoffs, F.col("cls") == F.col("query"), "left").select("cls", "vec", F.coalesce("cutoff", lowest).alias("cutoff")))
    found = against(told, "cutoff").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need)
    listed = found.join(corpus.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= need)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    own = asked.select(F.col("id").alias("query_id"), F.col("cls").alias("query")).distinct()
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Deduplicators: exact, and MinHash with locality-sensitive hashing."""

from __future__ import annotations

import re
import textwrap
from functools import lru_cache
from typing import Any, Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.plans.components import connected_components
from millrace.plans.durable import broadcast_if_small, durable
from millrace.plans.parts import in_parts
from millrace.plans.registry import operator

DedupMode = Literal["dedup", "dup", "dedup_with_dup"]


def _ranked(order_by: list[str] | None, df: DataFrame) -> tuple[Column, bool] | None:
    """What orders rows of a class, as one comparable struct, and whether the greatest stays. None: directions differ, so no one aggregate says it."""
    parts = []
    for text in order_by or []:
        m = re.fullmatch(r"(?is)\s*(.+?)(?:\s+(asc|desc))?\s*", text)
        parts.append((F.expr(m[1]), (m[2] or "asc").lower() == "desc"))
    down = {d for _, d in parts}
    if len(down) > 1:
        return None
    # what is left equal goes by a hash of the row, so that the choice does not depend on the layout
    plain = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema]
    return F.struct(*(c.alias(f"o{i}") for i, (c, _) in enumerate(parts)), F.xxhash64(F.lit(0), *plain).alias("h")), down == {True}


def _compiled(source: Any):
    """A function of two rows: a callable, or the body of one as text."""
    if callable(source):
        return source
    space: dict = {}
    exec("def choose(r1, r2):\n" + textwrap.indent(textwrap.dedent(source), "    "), space)  # noqa: S102  the user's own code, from the user's own configuration
    return space["choose"]


#: What a task of the tournament holds at most: rows, and their bytes in Arrow's form.
HELD_ROWS, HELD_BYTES = 50_000, 32 << 20


def _tournament(df: DataFrame, key: str, source: Any) -> DataFrame:
    """One row of each key by a pairwise choice: first within each task, then over what the tasks sent. Streams; holds no group."""
    arrow = to_arrow_schema(df.schema)

    def rounds(batches):
        choose, best, size = _compiled(source), {}, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for values in b.to_pylist():
                    row, k = Row(**values), values[key]
                    best[k] = choose(best[k], row) if k in best else row
                size += b.nbytes
                if len(best) > HELD_ROWS or size > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist([r.asDict() for r in best.values()], schema=arrow)
                    best.clear()
                    size = 0
        if best:
            yield pa.RecordBatch.from_pylist([r.asDict() for r in best.values()], schema=arrow)

    def final(batches):
        choose, held = _compiled(source), None
        for b in batches:
            for values in b.to_pylist():
                row = Row(**values)
                if held is not None and held[key] == values[key]:
                    held = choose(held, row)
                else:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held.asDict()], schema=arrow)
                    held = row
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.asDict()], schema=arrow)

    once = df.mapInArrow(rounds, df.schema)
    return once.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(final, df.schema)


def _by_mode(df: DataFrame, stays: Column, mode: str) -> DataFrame:
    if mode == "dedup_with_dup":
        return df.withColumn("__stay__", stays)
    return df.filter(stays if mode == "dedup" else ~stays)


def _by_aggregate(df: DataFrame, key: str, mode: str, order: Column, greatest: bool) -> DataFrame:
    """The best of each class by an aggregate, combined map-side; then rows meet only the classes that have several.

    Texts are shuffled only if those classes are too many to broadcast. Of rows equal in all columns one is as good as another: the
    least number of a row is taken, an aggregate too.
    """
    best = df.select(key, order.alias("o_")).groupBy(key).agg((F.max if greatest else F.min)("o_").alias("best_"), F.count("*").alias("n_"))
    best = durable(best.filter("n_ > 1").select(F.col(key).alias("key_"), "best_"))
    small = broadcast_if_small(best, 200_000)
    met = df.withColumn("o_", order).join(small, F.col(key).eqNullSafe(F.col("key_")), "left")
    chosen = F.col("o_").eqNullSafe(F.col("best_"))
    tied = met.filter(F.col("best_").isNotNull() & chosen)
    equal = durable(tied.groupBy(key).agg(F.count("*").alias("n_")).filter("n_ > 1").select(F.col(key).alias("equal_")))
    stays = F.col("best_").isNull() | chosen
    if not equal.limit(1).count():
        return _by_mode(met, stays, mode).drop("o_", "key_", "best_")
    several = chosen & F.col(key).eqNullSafe(F.col("equal_"))
    met = met.join(broadcast_if_small(equal.withColumn("several_", F.lit(True)), 200_000), several, "left")
    rest = _by_mode(met.filter("several_ IS NULL"), stays, mode)
    alike = durable(met.filter("several_").withColumn("number_", F.monotonically_increasing_id()))
    first = durable(alike.groupBy(key).agg(F.min("number_").alias("first_")).select(F.col(key).alias("one_"), "first_"))
    ones = alike.join(broadcast_if_small(first, 200_000), F.col(key).eqNullSafe(F.col("one_")))
    ones = _by_mode(ones, F.col("number_") == F.col("first_"), mode).drop("one_", "first_", "number_")
    return rest.unionByName(ones).drop("o_", "key_", "best_", "equal_", "several_")


def keep_by(df: DataFrame, key: str, mode: str, order_by: list[str] | None, comparison_function: Any = None) -> DataFrame:
    """``df`` by mode: the row of each ``key`` that stays, the others, or all with ``__stay__``."""
    if order_by and comparison_function:
        raise ValueError("order_by and comparison_function exclude each other")
    ranked = None if comparison_function else _ranked(order_by, df)
    if ranked:
        return _by_aggregate(df, key, mode, *ranked)
    rows = durable(df.withColumn("row_", F.monotonically_increasing_id()))
    if comparison_function:
        stay = _tournament(rows, key, comparison_function).select("row_")
    else:
        down = [bool(re.search(r"(?i)\sdesc\s*$", o)) for o in order_by]
        bare = [F.expr(re.sub(r"(?i)\s+(asc|desc)\s*$", "", o)) for o in order_by]
        # the first of each class: Spark sends one row of a class from each task
        w = Window.partitionBy(key).orderBy(*(c.desc() if d else c.asc() for c, d in zip(bare, down, strict=True)), "row_")
        stay = rows.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").select("row_")
    met = rows.join(stay.withColumn("stays_", F.lit(True)), "row_", "left")
    return _by_mode(met, F.coalesce("stays_", F.lit(False)), mode).drop("row_", "stays_")


@operator("exact_deduplicator", "table")
def exact_deduplicator(df: DataFrame, field: str, mode: DedupMode = "dedup", order_by: list[str] | None = None, comparison_function: Any = None) -> DataFrame:
    """Rows with equal fields are a class (nulls too), named by ``gid``, the field's SHA-256.

    Of a class the first by ``order_by`` (SQL expressions, ``desc`` allowed) stays, or the one that ``comparison_function(r1, r2)``
    chooses. ``dedup`` gives those, ``dup`` the others, ``dedup_with_dup`` all with ``__stay__``.
    """
    return keep_by(df.withColumn("gid", F.sha2(F.col(f"`{field}`").cast("binary"), 256)), "gid", mode, order_by, comparison_function)


@lru_cache(8)
def best_bands(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows a band with the least sum of false-positive and false-negative area, by quadrature."""
    below, above = np.linspace(0, threshold, 1001), np.linspace(threshold, 1, 1001)
    best = None
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            wrong = np.trapezoid(1 - (1 - below**r) ** b, below) + np.trapezoid((1 - above**r) ** b, above)
            if best is None or wrong < best[0]:
                best = wrong, b, r
    return best[1], best[2]


def gram_hashes(tokens: list[str], ngram: int) -> np.ndarray:
    """XXH32 of each token n-gram in lower case, joined by a space; fewer tokens are one gram."""
    import xxhash

    words = [t.encode("utf-8", "surrogatepass") for t in " ".join(tokens).lower().split(" ")] if all(" " not in t for t in tokens) else [t.lower().encode("utf-8", "surrogatepass") for t in tokens]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - ngram + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(ngram, len(words)) - 1 :].tolist()
    hash32 = xxhash.xxh32_intdigest
    return np.fromiter([hash32(joined[a:z]) for a, z in zip(starts, stops, strict=True)], np.uint64, n)


class Bands:
    """Hashes of the bands of MinHash signatures, by multiply-shift hashing (Dietzfelbinger, 1996): strongly universal from 32 bits to 32 bits."""

    def __init__(self, num_perm: int, b: int, r: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.c = rng.integers(0, 2**64, num_perm, np.uint64, endpoint=False), rng.integers(0, 2**64, num_perm, np.uint64, endpoint=False)
        self.a, self.c, self.b, self.r = self.a[: b * r, None], self.c[: b * r, None], b, r

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band."""
        import xxhash

        hashes = np.unique(hashes)
        least = np.full(self.b * self.r, 2**32 - 1, np.uint64)
        for at in range(0, len(hashes), 128):  # permutations by grams, as much as a core's cache holds
            v = self.a * hashes[at : at + 128]
            v += self.c
            least = np.minimum(least, v.min(axis=1) >> np.uint64(32))
        rows = least.reshape(self.b, self.r)
        return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(rows)], np.uint64).view(np.int64)


@operator("minhash_lsh_deduplicator", "table")
def minhash_lsh_deduplicator(
    df: DataFrame, field: str, threshold: float = 0.7, ngram_size: int = 5, text_min_length: int = 20, num_perm: int = 300, b: int | None = None, r: int | None = None, index_field: str | None = None,
    ev_partitions: int | None = None, mode: DedupMode = "dedup", order_by: list[str] | None = None, comparison_function: Any = None, seed: int = 19980731,
) -> DataFrame:
    """Near-duplicates by MinHash over token n-grams, joined where a band of the signatures is equal, with everything that links reach.

    The field is a text (split at non-word characters) or an array of tokens. Rows with fewer than ``text_min_length`` tokens, and
    nulls, are left out of every mode. ``__component__`` names the class; a row without near-duplicates is one by itself.
    Modes and ``order_by`` are as for exact duplicates. ``ev_partitions`` is accepted and left to adaptive execution.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    b, r = (b, r) if b and r else best_bands(threshold, num_perm)
    if b * r > num_perm:
        raise ValueError("b * r must not exceed num_perm")
    col = F.col(f"`{field}`")
    is_text = isinstance(df.schema[field].dataType, T.StringType)
    tokens = F.split(F.lower(col), r"(?U)\W", -1) if is_text else col
    # a text has a token more than characters to split at
    n_tokens = F.regexp_count(col, F.lit(r"(?U)\W")) + 1 if is_text else F.size(col)
    rows = df.filter(F.coalesce(n_tokens >= text_min_length, F.lit(False)))
    if index_field and index_field not in df.columns:
        rows = durable(rows.withColumn(index_field, F.monotonically_increasing_id()))

    def bands(lists: pa.Array) -> pa.Array:
        sign = Bands(num_perm, b, r, seed)
        return pa.array((sign(gram_hashes(["" if t is None else t for t in x], ngram_size)) for x in lists.to_pylist()), pa.list_(pa.int64()))

    # equal fields are one node, so a huge group of copies is one row from here on
    node = F.unhex(F.md5((col if is_text else F.to_json(col)).cast("binary")))
    entries = durable(rows.select(node.alias("node"), F.posexplode_outer(in_parts("array<long>", bands)(tokens)).alias("band", "hash")).distinct())
    first = entries.groupBy("band", "hash").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1")
    links = entries.join(first, ["band", "hash"]).select(F.col("node").alias("u"), "v")
    parts = connected_components(links).select(F.col("node").alias("node_"), "component")
    named = rows.join(broadcast_if_small(parts, 200_000), node == F.col("node_"), "left")
    named = named.withColumn("__component__", F.lower(F.hex(F.coalesce("component", node)))).drop("node_", "component")
    return keep_by(named, "__component__", mode, order_by, comparison_function)

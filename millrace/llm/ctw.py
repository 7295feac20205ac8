"""Language-model scores by context-tree weighting over bytes (Willems, Shtarkov and Tjalkens, 1995).

Every byte is eight binary decisions, each with a tree of contexts of its own: the bits of the byte so far, then the
preceding bytes, nearest first, up to ``depth``. At each node the Krichevsky-Trofimov estimate from the training texts'
counts is mixed with the product of the nodes below it, so that all depths take part with the weights that the training data
give them. A text's score is the logarithm of its probability under the trained mixture, its end included;
``code_length`` is the same in bits a byte.

How it is done: a pass over the texts cuts them into chunks of some MB, stores each chunk in packs, and writes which
(depth + 1)-grams and words it has. Grams of all chunks are summed and dealt by the two bytes nearest to the coded one; a task
reads the grams of one pair after another and computes their subtrees, and a pair of too many grams is dealt by the third byte too. The
nodes above those subtrees are joined on the driver: at most 65,536 of depth 0 and 1, and those of depth 2 of the pairs that were split,
which are never more than ``SPLIT_PAIRS``. Every chunk then gets the entries that its own texts ask for, so no table has to fit one machine,
and the shuffles grow as the corpus does. The entries that most chunks ask for, ``HOT`` at most, are sent to all workers once; the
others are joined. Texts are worked on in slices, so a very long one needs no more memory than its own bytes.

Texts are lower-cased (A-Z) first. The base score is of words with add-0.1 smoothing, as in ``score_corpus``. Grams are keys by
themselves; words are known by 63 bits of their XXH3 hash (a chance of 10^-7 that any two of a million distinct words share one).

Defined results: a null text is empty and has its end to score; null and repeated ids are rows as others (a null id is in
training); without training texts every bit has probability 1/2; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.rows import documents
from millrace.plans.durable import discard, durable

#: Bytes that UTF-8 never has: before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text that are worked on at once, and that are packed together.
SLICE, PACK = 512 << 10, 4 << 20
#: Entries that may be broadcast: some 8 MB as arrays, 50 MB as a hash table, whatever the corpus.
HOT = 1 << 19
#: A pair of nearest bytes is split if it has more grams than the first and than this part of all.
PAIR_GRAMS, SPLIT_PAIRS = 10_000, 1000
#: Grams that are worked on together, if their pairs are small.
TOGETHER = 500_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def slices(texts: Iterable[bytes], depth: int, size: int = SLICE) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of about ``size`` bytes of (number of the text, the ``depth`` bytes before, bytes to code); long texts are cut, each has its end."""
    held, n, pad = [], 0, bytes([BEFORE]) * depth
    for i, t in enumerate(texts):
        coded, at, before = t + b"\xff", 0, pad
        while at < len(coded):
            part = coded[at : at + size - n].lower()
            held.append((i, before, part))
            at, n, before = at + len(part), n + len(part), (before + part)[-depth:]
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def grams(parts: list[tuple[int, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte to code, coded byte lowest, and the number of its text."""
    data = np.frombuffer(b"".join([before + part for _, before, part in parts]), np.uint8)
    sizes = np.fromiter((len(part) for *_, part in parts), np.int64, len(parts))
    keys = np.zeros(len(data) - depth, np.int64)
    for back in range(depth, -1, -1):
        keys <<= 8
        keys |= data[depth - back : len(data) - back]
    real = np.ones(len(data), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return keys[real[depth:]], np.repeat(np.fromiter((i for i, *_ in parts), np.int64, len(parts)), sizes)


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def word_keys(texts: Iterable[bytes], size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The key of each word, which is negative, and the number of its text, for about ``size`` bytes at a time."""
    hashes, own, held = [], [], 0

    def out():
        return (np.array(hashes, np.uint64) | np.uint64(1 << 63)).view(np.int64), np.array(own, np.int64)

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            gap = _BLANK.search(t, at + size)
            end = gap.start() if gap else len(t)
            words = t[at:end].lower().split()
            hashes += map(xxhash.xxh3_64_intdigest, words)
            own += [i] * len(words)
            held, at = held + end - at, end
            if held >= size:
                yield out()
                hashes, own, held = [], [], 0
    if hashes:
        yield out()


def _texts(table: pa.Table) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() for t in table.column(2))


def _entries(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of grams and words with their counts in training texts (0 where only held-out ones have them)."""
    train = ~np.asarray(table.column(1))
    keys, counts, new = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    found = (grams(parts, depth) for parts in slices(_texts(table), depth))
    for source in (found, word_keys(_texts(table))):
        for k, own in source:
            codes, unique = pd.factorize(k)
            keys.append(unique)
            counts.append(np.bincount(codes, train[own], len(unique)))
            new += len(unique)
            if new > max(500_000, len(keys[0])):
                k, c = _sum_by(np.concatenate(keys), np.concatenate(counts))
                keys, counts, new = [k], [c], 0
    return _sum_by(np.concatenate(keys), np.concatenate(counts))


_CHUNK = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("pack", pa.binary())])


def _chunks(docs: DataFrame, depth: int, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: a key that a chunk asks for, and the chunk itself, packed."""

    def emit(held):
        table = pa.Table.from_batches(held)
        name = int.from_bytes(os.urandom(8)) >> 1
        keys, counts = _entries(table, depth)
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), name)), pa.array(k), pa.array(counts[at : at + 100_000]), pa.nulls(len(k), pa.binary())], schema=_CHUNK)
        ends = np.cumsum(pc.binary_length(table.column(2)).to_numpy()) // PACK
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), table.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.slice(a, z - a).combine_chunks())
            yield pa.RecordBatch.from_pydict({"chunk": [name], "key": [None], "n": [None], "pack": [out.getvalue().to_pybytes()]}, schema=_CHUNK)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            at = 0
            lengths = pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False)
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= chunk_bytes:
                    yield from emit([*held, whole.slice(at, i + 1 - at)])
                    held, size, at = [], 0, i + 1
            if at < whole.num_rows:
                held.append(whole.slice(at))
        if held:
            yield from emit(held)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return durable(docs.select("doc_id", held_out().alias("held_out"), text).mapInArrow(run, "chunk long, key long, n long, pack binary"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    return s - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of any sequence of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability of nodes, and the share of their own estimate in it."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def _subtrees(keys: np.ndarray, n: np.ndarray, depth: int, top: int = 2):
    """For each of the eight bits: the nodes at depth ``top`` (key, zeros, ones, log weighted probability), and each
    gram's predicted probability of its own bit from there down."""
    symbol = keys & 0xFF
    for j in range(8):
        prefix = (1 << j) | (symbol >> (8 - j))
        bit = (symbol >> (7 - j)) & 1
        levels = []
        for d in range(depth, top - 1, -1):
            nodes, at = np.unique(((keys >> 8) & ((1 << 8 * d) - 1)) << 8 | prefix, return_inverse=True)
            ones, total = np.bincount(at, n * bit, len(nodes)), np.bincount(at, n, len(nodes))
            levels.append((d, nodes, at, total - ones, ones))
        weighted = predicted = lower = None
        for d, nodes, at, zeros, ones in levels:
            own = log_kt(zeros, ones)
            estimate = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            if weighted is None:
                weighted, predicted = own, estimate
            else:
                parent = np.searchsorted(nodes, (lower >> 8 & ((1 << 8 * d) - 1)) << 8 | lower & 0xFF)
                weighted, share = _mixed(own, np.bincount(parent, weighted, len(nodes)))
                predicted = share[at] * estimate + (1 - share[at]) * predicted
            lower = nodes
        yield prefix, bit, lower, levels[-1][3], levels[-1][4], weighted, predicted


def _upper(roots: pd.DataFrame, split: np.ndarray):
    """Counts and shares of the nodes of depth 0, 1 and, of the ``split`` pairs, 2, as arrays by nearest bytes and bits so far.

    ``roots``: sums over the nodes below, by ``near``, the nearest byte, or 256 + the number of the split pair.
    """
    zeros, ones, below = (np.zeros((256 + len(split), 256)) for _ in range(3))
    at = roots["near"].to_numpy(np.int64), roots["prefix"].to_numpy(np.int64)
    for to, name in ((zeros, "zeros"), (ones, "ones"), (below, "weighted")):
        to[at] = roots[name]
    weighted2, share2 = _mixed(log_kt(zeros[256:], ones[256:]), below[256:])
    deep = zeros[256:], ones[256:], share2
    for to, more in ((zeros, zeros[256:]), (ones, ones[256:]), (below, np.where(zeros[256:] + ones[256:] > 0, weighted2, 0))):
        np.add.at(to, split & 0xFF, more)
    zeros, ones = zeros[:256], ones[:256]
    weighted, share = _mixed(log_kt(zeros, ones), below[:256])
    zeros0, ones0 = zeros.sum(0), ones.sum(0)
    return (zeros0, ones0, _mixed(log_kt(zeros0, ones0), weighted.sum(0))[1]), (zeros, ones, share), deep


def gram_scores(counts: DataFrame, depth: int, most: int = PAIR_GRAMS) -> DataFrame:
    """``gram, logp`` (base 10) of the last byte given those before it, from ``gram, n`` of distinct grams."""
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    sizes = dict(counts.groupBy(pair.alias("pair")).count().collect()) if depth > 2 else {}  # of 65,536 pairs at most
    split = np.array(sorted(p for p, n in sizes.items() if n > most and n * SPLIT_PAIRS > sum(sizes.values())), np.int64)
    number = np.full(1 << 16, -1)
    number[split] = np.arange(len(split))
    third = F.shiftright("gram", 24).bitwiseAND(F.lit(0xFF))
    group = pair * 512 + (F.when(pair.isin(split.tolist()), third + 1).otherwise(0) if len(split) else 0)
    dealt = counts.select("gram", "n", group.alias("group")).repartition("group").sortWithinPartitions("group")

    def gathered(batches):
        """Whole groups, some together: their grams and counts, those of split pairs by themselves."""
        held, n = [], 0

        def out(parts):
            keys, counts, groups = (np.concatenate([p[i] for p in parts]) for i in range(3))
            deep = groups & 511 > 0
            return [(keys[m], counts[m], top) for m, top in ((~deep, 2), (deep, 3)) if m.any()]

        for b in batches:
            keys, counts, groups = (np.asarray(c) for c in b.columns)
            if not len(keys):
                continue
            if n >= TOGETHER:
                # what is held is complete but for the last group, which may go on here
                cut = int(np.searchsorted(groups, held[-1][2][-1], "right")) if groups[0] == held[-1][2][-1] else 0
                if cut < len(keys):
                    yield from out([*held, (keys[:cut], counts[:cut], groups[:cut])])
                    held, n, keys, counts, groups = [], 0, keys[cut:], counts[cut:], groups[cut:]
            held.append((keys, counts, groups))
            n += len(keys)
        if held:
            yield from out(held)

    def roots(batches):
        for keys, n, top in gathered(batches):
            for _, _, nodes, zeros, ones, weighted, _ in _subtrees(keys, n, depth, top):
                up, at = np.unique((nodes >> 8 & (1 << 8 * (top - 1)) - 1) << 8 | nodes & 0xFF, return_inverse=True)
                sums = [np.bincount(at, x, len(up)) for x in (zeros, ones, weighted)]
                near = up >> 8 if top == 2 else 256 + number[up >> 8]
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(up & 0xFF), *map(pa.array, sums)], names=["near", "prefix", "zeros", "ones", "weighted"])

    found = dealt.mapInArrow(roots, "near long, prefix long, zeros double, ones double, weighted double")
    upper = _upper(found.groupBy("near", "prefix").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toPandas(), split)
    sent = counts.sparkSession.sparkContext.broadcast(upper)

    def mixed(p, bit, prefix, nodes, near=None):
        """Predictions taken one node up, whose arrays are ``nodes``."""
        at = prefix if near is None else (near, prefix)
        zeros, ones, share = (x[at] for x in nodes)
        return share * (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - share) * p

    def score(batches):
        root, first, second = sent.value
        for keys, n, top in gathered(batches):
            logp = np.zeros(len(keys))
            for prefix, bit, *_, p in _subtrees(keys, n, depth, top):
                if top == 3:
                    p = mixed(p, bit, prefix, second, number[keys >> 8 & 0xFFFF])
                logp += np.log10(mixed(mixed(p, bit, prefix, first, keys >> 8 & 0xFF), bit, prefix, root))
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(logp[at : at + 100_000])], names=["gram", "logp"])

    return dealt.mapInArrow(score, "gram long, logp double")


def _often(sums: DataFrame) -> Column:
    """Which of ``sums(key, asked)`` are asked for by most chunks: about ``HOT`` keys, all of which two chunks at least ask for.

    Keys are counted by steps of ``asked``; of the step that doesn't fit as a whole, a part by the keys' hash.
    """
    step = F.floor(F.log2("asked") * 8)
    counts = sums.filter("asked > 1").groupBy(step.alias("step")).agg(F.count("*").alias("keys"))
    room, least, at, part = HOT, 1 << 40, -1, 0.0
    for at, keys in sorted(counts.collect(), reverse=True):  # some 500 steps at most
        if keys > room:
            part = room / keys
            break
        room, least = room - keys, at
    some = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(part * (1 << 20))
    return (F.col("asked") > 1) & ((step >= least) | (step == at) & some)


def score_corpus(docs: DataFrame, depth: int = 5, chunk_bytes: int = 24 << 20, pair_grams: int = PAIR_GRAMS) -> DataFrame:
    """Scores of every row of ``docs``, learnt from those that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length``. A row is held out if its id's
    crc32 is divisible by 10. ``base_score``: sum over words and one end of log10((c + 0.1) / (N + 0.1 (V + 1))).
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    chunks = _chunks(docs, depth, chunk_bytes)
    asked = chunks.filter("key IS NOT NULL").select("chunk", "key")
    sums = durable(chunks.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("asked")))
    model = gram_scores(sums.filter("key >= 0").select(F.col("key").alias("gram"), "n"), depth, pair_grams)
    answers = model.select(F.col("gram").alias("key"), F.col("logp").alias("value")).unionByName(sums.filter("key < 0").select("key", F.col("n").cast("double").alias("value")))
    answers = durable(answers)
    often = durable(sums.filter(_often(sums)).select("key"))
    hot = answers.join(F.broadcast(often), "key").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((hot.column("key").to_numpy(), hot.column("value").to_numpy()))
    rest = asked.join(F.broadcast(often), "key", "left_anti").join(answers, "key").select("chunk", "key", "value")
    packs = chunks.filter("pack IS NOT NULL").select(F.col("chunk").alias("whole"), "pack")
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def run(key, packed, entries):
        keys = np.concatenate([sent.value[0], np.asarray(entries.column("key"))])
        values = np.concatenate([sent.value[1], np.asarray(entries.column("value"))])
        index = pd.Index(keys)
        tables = []
        for raw in packed.column("pack"):
            table = pa.ipc.open_stream(raw.as_buffer()).read_all()
            n_rows = table.num_rows
            n_tokens, n_known, base, score = (np.zeros(n_rows, kind) for kind in (np.int64, np.int64, np.float64, np.float64))
            for parts in slices(_texts(table), depth):
                k, own = grams(parts, depth)
                score += np.bincount(own, values[index.get_indexer(k)], n_rows)
            for k, own in word_keys(_texts(table)):
                counts = values[index.get_indexer(k)]
                n_tokens += np.bincount(own, minlength=n_rows)
                n_known += np.bincount(own, counts > 0, n_rows).astype(np.int64)
                base += np.bincount(own, np.log10(counts + 0.1), n_rows)
            size = pc.binary_length(table.column(2))
            columns = [table.column(0), table.column(1), *map(pa.array, (n_tokens, n_known, base, score)), size]
            tables.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    spark_schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"
    v = sums.filter("key < 0 AND n > 0").count()
    discard(sums)
    rows = durable(packs.groupBy("whole").cogroup(rest.groupBy("chunk")).applyInArrow(run, spark_schema))
    trained = F.when(~F.col("held_out"), 1).otherwise(0)
    n_words, n_ends = (x or 0 for x in rows.agg(F.sum(F.col("n_tokens") * trained), F.sum(trained)).first())
    discard(chunks, answers, often)
    v += n_ends > 0
    n = n_words + n_ends
    norm = float(np.log10(n + 0.1 * (v + 1)))
    tokens = F.col("n_tokens") + 1
    base = F.col("logs") + F.lit(float(np.log10(n_ends + 0.1))) - tokens * F.lit(norm)
    return rows.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("n_known") + int(n_ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("code_length"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))

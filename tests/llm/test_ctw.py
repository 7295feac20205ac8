import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import xxhash

from millrace.llm.ctw import grams, query, score_corpus, slices, word_keys


def stream(text, depth):
    data = bytes([0xFE]) * depth + re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode() + b"\xff"
    for i in range(depth, len(data)):
        yield data[i], data[i - depth : i][::-1]


def brute_ctw(train, texts, depth):
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for x, ctx in stream(t, depth):
            for j in range(8):
                prefix = (1 << j) | (x >> (8 - j))
                for d in range(depth + 1):
                    counts[ctx[:d], prefix][x >> (7 - j) & 1] += 1
                    if d:
                        below[ctx[: d - 1], prefix].add(ctx[:d])
    weighted = {}

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def logw(ctx, prefix):
        node = ctx, prefix
        if node not in weighted:
            e = own(node)
            if len(ctx) < depth:
                rest = sum(logw(c, prefix) for c in below.get(node, ()))
                top = max(e, rest)
                e = top + math.log(math.exp(e - top) + math.exp(rest - top)) - math.log(2)
            weighted[node] = e
        return weighted[node]

    def predict(ctx, prefix, bit, d):
        node = ctx[:d], prefix
        n = counts.get(node, (0, 0))
        p = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return p
        share = math.exp(own(node) - math.log(2) - logw(*node))
        return share * p + (1 - share) * predict(ctx, prefix, bit, d + 1)

    return [sum(math.log10(predict(ctx, (1 << j) | (x >> (8 - j)), x >> (7 - j) & 1, 0)) for x, ctx in stream(t, depth) for j in range(8)) for t in texts]


def brute_base(train, texts):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for t in train for w in words(t))
    n = c.total()
    return n, [(len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words(t))) for t in texts]


def held(i):
    return i is not None and crc32(str(i).encode()) % 10 == 0


def check(rows, got, depth):
    train = [t for i, t in rows if not held(i)]
    texts = [t for _, t in rows]
    n, base = brute_base(train, texts)
    scores = brute_ctw(train, texts, depth)
    want = sorted(((i, held(i), a, b, n, round(c, 6), round(s, 6)) for (i, _), (a, b, c), s in zip(rows, base, scores, strict=True)), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str) == want


ROWS = [(i, f"The cat sat on mat {i % 3}. Ünïcode hat") for i in range(12)] + [(1, "A B a b"), (None, None), (None, "x"), (50, ""), (51, "zz " * 400), (51, "zz " * 400), (10, "unseen Words here")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as gram", "2 as chunk", "3 as n")
    for depth, size, pair in ((2, 1 << 20, 10), (4, 100, 1 << 20), (3, 300, 3), (5, 1 << 20, 0)):
        check(ROWS, score_corpus(df.repartition(3), depth, size, pair).collect(), depth)
    assert score_corpus(df.limit(0)).collect() == []
    out = [(i, t) for i, t in ROWS if held(i)]
    assert out
    check(out, score_corpus(spark.createDataFrame(out, "doc_id long, text string"), 3).collect(), 3)


def test_query(spark):
    rows = query(spark, "/root/testdata/sf0.001").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    n, base = brute_base([t for i, t in docs.items() if not held(i)], [docs[r.doc_id] for r in rows])
    for r, (a, b, c) in zip(rows, base, strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), a, b, n) and math.isclose(r.base_score, c, rel_tol=1e-9)
        assert 0 < r.code_length < 8 and math.isfinite(r.score)


def test_slices_of_long_texts():
    """Texts are cut anywhere for grams, at blanks for words; what comes out is that of the whole."""
    texts = [b"One two  three", b"", b"x" * 50 + b" Y z" + b" " * 30 + b"end", b"\n\t ", "é à".encode() * 9]
    for size in (1, 3, 7, 1000):
        keys, own = (np.concatenate(x) for x in zip(*(grams(p, 3) for p in slices(texts, 3, size)), strict=True))
        want = []
        for i, t in enumerate(texts):
            data = b"\xfe" * 3 + t.lower() + b"\xff"
            want += [(i, int.from_bytes(data[j - 3 : j + 1])) for j in range(3, len(data))]
        assert list(zip(own.tolist(), keys.tolist(), strict=True)) == want
        keys, own = (np.concatenate(x) for x in zip(*word_keys(texts, size), strict=True))
        want = [(i, xxhash.xxh3_64_intdigest(w) | 1 << 63) for i, t in enumerate(texts) for w in t.lower().split()]
        assert list(zip(own.tolist(), (keys.view(np.uint64)).tolist(), strict=True)) == want


def test_long_text(spark):
    rows = [(i, t) for i, t in enumerate(["Some words here and there, " * 30_000, "some other words", "x" * 900_000, None])]
    got = score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [150_001, 4, 2, 1]
    n, base = brute_base([t for i, t in rows if not held(i)], [t for _, t in rows])
    for r in got:
        assert math.isclose(r.base_score, base[r.doc_id][2], rel_tol=1e-9) and r.train_tokens == n and (r.doc_id == 3 or 0 < r.code_length < 9)

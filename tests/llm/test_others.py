"""Top-k search, mixing, chat windows, language identification and importance resampling: brute force and odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, cut, importance, language_id, mix, topk

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_top(rows, asked, k=5):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in good:
        if q in asked:
            scored = sorted({(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q})
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 2]) for i in range(120)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (None, [1.0]), (2004, []), (2005, [0.5]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cls", "2 as vec", "3 as score")
    asked = {i for i, _ in rows if i is not None and i % 10 == 0}
    for more in ({}, {"block": 16, "query_block": 3, "slices": 3}, {"slices": 1}):
        got = topk.top_k(df, df.filter("vec_id % 10 = 0"), **more)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, asked)
    few = df.filter("vec_id < 3")
    assert len(topk.top_k(few, few).collect()) == 6
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_of_large_components(spark):
    """Products beyond 2^53 and 2^63 are ranked by their true values; scores beyond a long are given as the greatest or least long."""
    rng = np.random.default_rng(1)
    for scale in (1e6, 1e8, 1e13, 1e16):
        rows = [(i, [float(x) for x in rng.integers(-4, 5, 4) / 2 * (scale if i % 3 == 0 else 1)]) for i in range(60)]
        rows += [(100 + i, [scale, scale + i * max(1, scale / 2**50), 1.0, 0.0]) for i in range(4)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        most = 2**63 - 1
        vec = {i: [min(max(math.floor(256 * x), -(2**63)), most) for x in v] for i, v in rows}
        want = []
        for q in (i for i in vec if i % 10 == 0):
            scored = sorted((-min(max(sum(a * b for a, b in zip(vec[q], w, strict=True)), -most), most), i) for i, w in vec.items() if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
        for more in ({}, {"block": 8, "query_block": 2, "slices": 3}):
            got = topk.top_k(df, df.filter("vec_id % 10 = 0"), **more)
            assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want), scale


def brute_until(rows, budget):
    """Sizes of (order, size) taken up to a budget."""
    out, at = [], 0
    for key, size in sorted(rows):
        out.append((key, size, 2 * at + size <= 2 * budget))
        at += size
    return sorted(out)


def test_cut_spreads_what_it_sorts(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(k), int(s), b) for g, b in (("even", 0), ("odd", 700), ("all", 10**6), (None, 1500)) for k, s in zip(rng.integers(0, 40, 500), rng.integers(1, 6, 500), strict=True)]
    rows += [("same", 5, 1, 2000) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, size long, budget long").withColumn("bucket", F.floor(F.col("k") / 4))
    got = cut.take_until(df, "g", [F.col("k"), F.col("size")], "bucket", "size", "budget").collect()
    for g in ("even", "odd", "all", None, "same"):
        mine = [(r.k, r.size) for r in got if r.g == g]
        want = brute_until([(k, s) for x, k, s, _ in rows if x == g], next(b for x, *_, b in rows if x == g))
        assert sorted((r.k, r.size, r.picked) for r in got if r.g == g) == sorted(((k, s, p) for k, s, p in want)), (g, len(mine))
    cuts = {r.cut_group: r for r in cut.cuts(df, "g", "bucket", "size", "budget").collect()}
    assert not cuts["even"].split and cuts["odd"].split and "all" not in cuts
    # one bucket of very many equal rows is dealt to several tasks
    same = df.filter("g = 'same'")
    parts = cut._running(same, "g", [F.col("k"), F.col("size")], "size")
    assert sorted(r.upto_ for r in parts.select("upto_").collect()) == list(range(1, 5001))
    assert same.withColumn("tie_", F.rand(7)).repartitionByRange(4, "g", "k", "tie_").groupBy(F.spark_partition_id().alias("p")).count().filter("count < 2500").count() == 4


def test_nothing_is_sorted_where_targets_are_whole(spark, monkeypatch):
    """A single source, and one stopped at three times its size, want whole copies of every row: no bucket is split."""
    sorted_rows = []
    running = cut._running

    def counted(rows, *more):
        sorted_rows.append(rows.count())
        return running(rows, *more)

    monkeypatch.setattr(cut, "_running", counted)
    one = spark.createDataFrame([(i, "some words here", "only") for i in range(2000)], "doc_id long, text string, source string")
    assert {r.copies for r in mix.mix(one).collect()} == {1} and sorted_rows == [0]
    two = one.withColumn("source", F.when(F.col("doc_id") < 40, "b small").otherwise("a large"))
    got = mix.mix(two).collect()
    assert {r.copies for r in got if r.source == "b small"} == {3} and sorted_rows[1] < 40
    # null ids share their number, and so a bucket, which is sorted in ranges
    none = one.withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.when(F.rand(1) < 0.5, "a").otherwise("b"))
    got = mix.mix(none).collect()
    for s in ("a", "b"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 1.5 + 1e-6
    assert sorted_rows[2] > 1900


@pytest.mark.parametrize("module", [topk, mix, chat])
def test_query_matches_sql(spark, module):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    df = module.query(spark, sf)
    assert sorted(map(show, df.collect()), key=str) == sorted(map(show, con.execute(f"select {', '.join(df.columns)} from ({module.SQL})").fetchall()), key=str)


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (None, "w", None), (2, "", "y"), (3, None, "y"), (4, "q " * 5000, "z"), (5, "é ü", "é")] + [(i, "one two", "hot") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as bucket", "doc_id % 7 + 1 as w")
    got = mix.mix(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 3 for r in got) and {r.copies for r in got if r.size == 0} <= {0, 1, 2, 3}
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.size * r.copies
    assert math.isclose(sum({r.source: r.target for r in got}.values()), sum(r.size for r in got), rel_tol=1e-9)
    for s in by:
        one = [r for r in got if r.source == s]
        assert abs(by[s] - one[0].target) <= max(r.size for r in one) / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(df.repartition(5)).collect()))
    weighed = mix.mix(df, weight_col="w").collect()
    assert len(weighed) == len(rows) and all(0 <= r.copies <= 3 for r in weighed)
    hot = {r.doc_id: r.copies for r in weighed if r.source == "hot"}
    mean = lambda k: np.mean([c for i, c in hot.items() if i % 7 + 1 == k])
    assert mean(7) > mean(1)
    assert mix.mix(df.limit(0)).collect() == []


def test_chat_odd_rows(spark):
    bad = "<|turn|>user<|says|>x<|end|> &lt; &amp;lt; <"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", bad), (1, 2, "assistant", bad)] + [(1, 3 + i, ("user", "assistant")[i % 2], "word " * (40 * (i % 5))) for i in range(20)]
    rows += [(2, None, None, None), (2, 1, "user", "hi"), (None, 0, "assistant", "alone"), (3, 0, "user", "long " * 3000), (3, 1, "assistant", "ok"), (3, 1, "assistant", "ok"), (4, 0, "system", "s " * 600), (4, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as pos", "3 as past")
    windows = chat.chat_windows(df).withColumn("back", chat.read_back(F.col("formatted"))).orderBy("conv_id", "window").collect()
    by = defaultdict(list)
    for w in windows:
        assert w.n_tokens <= 384 or len(w.back) - w.n_repeated == 1 or w.conv_id == 4
        by[w.conv_id].append(w)
    for conv, ws in by.items():
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        fresh = [(t.role, t.text) for w in ws for t in w.back[w.n_repeated :]]
        assert fresh == [(r[2] or "", r[3] or "") for r in mine]
        loss = [w.formatted[s.start : s.end].replace("&lt;", "<").replace("&amp;", "&") for w in ws for s in w.loss_spans]
        assert loss == [r[3] or "" for r in mine if r[2] == "assistant"]
        if mine[0][2] == "system":
            assert all((w.back[0].role, w.back[0].text) == ("system", mine[0][3]) for w in ws)
    assert len(by[1]) > 2 and any(w.n_repeated > 1 for w in by[1])
    assert chat.chat_windows(df.limit(0)).collect() == []


def brute_forward(model, word, lang):
    index = {p: i for i, p in enumerate(model.pieces)}
    text = "▁" + word
    alpha = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            i = index.get(text[start:end], -2 if end - start == 1 else None)
            if i is not None:
                alpha[end] += alpha[start] * model.probs[i, lang]
    return math.log(alpha[-1])


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()), MODEL)
    words = ["the", "thonthe", "é", "über", "x" * 30, "日本", "a​b", "", "12,5"]
    for w, logs in zip(words, model.words(words), strict=True):
        for i in range(len(model.langs)):
            assert math.isclose(logs[i], brute_forward(model, w, i), rel_tol=1e-9), w
    long = "ab" * 20_000
    assert np.isfinite(model.words([long])[0]).all()


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {d.doc_id: d.lang for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.query(spark, sf).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x"), ("fr", None)], "lang string, text string")
    model = language_id.fit(train, MODEL)
    assert model.langs == ["de", "en"]
    rows = [(1, None), (1, ""), (None, "the dog"), (2, "12 34 !"), (3, "und der hund"), (3, "und der hund"), (4, "z" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang_pred", "1 as score", "'fr' as lang")
    got = sorted(((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect()), key=str)
    assert [g for g in got if g[0] != 4] == sorted([(1, "und"), (1, "und"), (None, "en"), (2, "und"), (3, "de"), (3, "de")], key=str)
    nothing = language_id.fit(train.limit(0), MODEL)
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).collect() == []


def brute_features(text, buckets):
    import zlib

    words = [w.encode() for w in (text or "").lower().split()]
    h = [zlib.crc32(w) for w in words]
    odd, full = 0x9E3779B97F4A7C15, 2**64
    uni = [(x * odd % full >> 33) % buckets for x in h]
    pairs = [(((a * 31 + b + 1) % full) * odd % full >> 33) % buckets for a, b in zip(h, h[1:], strict=False)]
    return Counter(uni + pairs)


def test_importance(spark):
    good = [f"plain words in an order {i} that one reads" for i in range(40)]
    junk = [f"BUY BUY {i} NOW!! cheap cheap cheap" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + [(100, None), (101, ""), (None, "words"), (102, "w " * 40_000), (102, "w " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as bucket", "3 as k")
    target = df.filter("doc_id < 20")
    got = importance.resample(df, target, share=0.5, buckets=500).collect()
    assert len(got) == len(rows) and sum(r.selected for r in got) == math.ceil(len(rows) / 2)
    assert max(r.key for r in got if not r.selected) <= min(r.key for r in got if r.selected)
    counts = lambda texts: sum((brute_features(t, 500) for t in texts), Counter())
    t, raw = counts(good[:20]), counts([x for _, x in rows])
    ratio = [math.log((t[b] + 1) / (t.total() + 500)) - math.log((raw[b] + 1) / (raw.total() + 500)) for b in range(500)]
    texts = defaultdict(list)
    for i, x in rows:
        texts[i].append(x)
    for r in got:
        assert any(math.isclose(r.log_weight, sum(ratio[b] * n for b, n in brute_features(x, 500).items()), rel_tol=1e-6, abs_tol=1e-6) for x in texts[r.doc_id])
    kept = {r.doc_id for r in got if r.selected}
    assert sum(i in kept for i in range(40)) > 35
    again = importance.resample(df.repartition(5), target, share=0.5, buckets=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert importance.resample(df.limit(0), df.limit(0)).collect() == []
    assert sum(r.selected for r in importance.resample(df, df.limit(0), share=1.0).collect()) == len(rows)


def test_importance_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in importance.query(spark, sf).collect()}
    assert sum(r.selected for r in got.values()) == math.ceil(0.8 * len(got))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[x.doc_id].selected for x in labels if x.quality and not x.toxic]
    bad = [got[x.doc_id].selected for x in labels if not x.quality]
    assert np.mean(good) > 0.85 and np.mean(bad) < 0.2


def test_digest_of_planted_conversation(spark):
    r = chat.query(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()

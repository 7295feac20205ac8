import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_exact_dedup import brute
from test_near_copies import stay

import corpus_pipeline
from millrace.llm.mix import query as mix_query


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding"]


def words_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text))


def check_run(spark, sf):
    """``run`` over ``documents`` against the stages done plainly: who stays, what is taken of each source, the library's ids."""
    rows = [(d.doc_id, d.text, d.source) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    left = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    stays = {(norm, keep) for _, keep, _, kept, norm in brute([r[:2] for r in left]) if kept}
    digest = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t).encode()).hexdigest()
    one = {}
    for r in sorted(left, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0, str(r[2]))):
        if (digest(r[1]), r[0]) in stays:
            one.setdefault(digest(r[1]), r)
    left = sorted(one.values(), key=lambda r: (r[0] is None, r[0] or 0))
    at = set(stay([(i, r[1]) for i, r in enumerate(left)]))
    left = [r for i, r in enumerate(left) if i in at]
    got = corpus_pipeline.run(spark, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    copies = Counter((r.doc_id, r.source, tuple(r.ids)) for r in got)
    ids = {(i, s, tuple(sp.encode(t))): t for i, t, s in left}
    assert set(copies) <= set(ids) and max(copies.values(), default=0) <= 3
    assert all(r.n_tokens == len(r.ids) for r in got)
    total, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for (i, s, x), t in ids.items():
        total[s] += words_of(t)
        taken[s] += words_of(t) * copies[i, s, x]
        most[s] = max(most[s], words_of(t))
    want = fill(total)
    for s in total:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    return got


def test_run_matches_brute_force(spark):
    assert len(check_run(spark, "/root/testdata/sf0.001")) > 100


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, copies over sources, columns of clashing names; then nothing at all."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "dog", "over", "river", "house", "and", "green", "stone"]) + str(rng.randrange(50)) for _ in range(n))
    text, long = prose(80), prose(30_000)
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text.replace(" ", "  "), "en", "b"), (None, text, None, None), (3, None, "en", "a"), (4, "", "en", None), (5, "12 34 !", "en", "a"), (6, " \n\t", None, "b")]
    rows += [(7, long, "en", "a"), (8, long + " more", "en", "b"), (9, long, None, "c"), (10, "x", "en", "c"), (None, "alone here", "de", "c"), (None, "alone here", "de", "c"), (11, "é" * 5000, "fr", "a")]
    rows += [(100 + i, prose(40), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(120)]
    rows += [(300 + i, "one group of very many copies, of these words", "en", "a") for i in range(60)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text")).selectExpr("*", "1 as tag", "2 as row_tag_", "3 as all", "4 as copies", "5 as lang_pred", "6 as ids", "7 as node", "8 as keys")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = check_run(spark, str(tmp_path))
    assert {r.doc_id for r in got} & {7, 8, 9} <= {7} and not {r.doc_id for r in got} & {3, 4, 5, 6, *range(301, 360)}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    unlabelled.write.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/unlabelled").collect() == []


def fill(total, most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(total.values()))
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > most * total[s]}
        if not full:
            return target | {s: weight[s] * share for s in open_}
        for s in full:
            target[s] = most * total[s]
            rest -= target[s]
        open_ -= full
    return target


def test_mix_targets_and_reruns(spark):
    rows = [r.asDict() for r in mix_query(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mix_query(spark, "/root/testdata/sf0.01").collect())
    docs = {d.doc_id: d.source for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[docs[r["doc_id"]]] += r["taken"]
        most[docs[r["doc_id"]]] = max(most[docs[r["doc_id"]]], r["size"])
    want = fill({docs[r["doc_id"]]: r["source_size"] for r in rows})
    for r in rows:
        s = docs[r["doc_id"]]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6

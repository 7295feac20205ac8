import hashlib

import public_tokenizers
import pytest
import sentencepiece

from millrace.llm.sp_codec import ChunkTable, query, sp_encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "\n", " \n", "a\nb c\t d", "▁", "▁▁a ▁b", "x▁ y", "ﬁ ①② 😀 \x00z", "</s> <s> <unk> <0x41>",
    "é́ü ñ", "word " * 300, "z" * 5000, "ab " * 3 + "\r\n 　x", " " * 40 + "q" + " " * 17, "​﻿", "日本語 の テキスト",
]


def test_chunks_match_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for entries in (300_000, 3):
        table = ChunkTable(MODEL, entries=entries, longest=8)
        for _ in range(2):
            for text, (raw, back) in zip(TEXTS, table.encode(TEXTS), strict=True):
                ids = sp.encode(text)
                assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == ids, text
                assert back == sp.decode(ids), text


def test_nulls_repeats_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "a b", "k"), (1, "a b", None), (None, "", "k")], "doc_id long, text string, ids string")
    rows = sp_encode(df, MODEL).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in rows) == [(0, 0, ""), (1, 0, ""), (1, 2, "a b"), (1, 2, "a b")]
    assert sp_encode(df.filter("doc_id > 5"), MODEL).collect() == []
    with pytest.raises(ValueError):
        sp_encode(df, MODEL, keep=("ids",))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = sp.encode(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()

"""SentencePiece encoding and decoding with a distinct-chunk table.

In the vocabularies this takes, no piece has a whitespace marker after another character,
so no merge crosses the place before a marker: the normalised text can be cut there, each
distinct marked word segmented once, and the ids put together again by position. Each task
keeps such a table, of bounded size; words that are not in it yet are given to the library in
one call for some hundred texts.

Defined results: a null text is empty, an empty text has no ids and decodes to an empty
string; the identifier column may hold nulls and repeats, rows are kept one to one; other
columns of the input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rows import documents
from millrace.llm.word_cache import WordCache

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Marked words already segmented: key (the word without its first marker) -> (ids as int32 bytes, text)."""

    def __init__(self, model: str, entries: int = 80_000, longest: int = 64):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing or self.sp.encode("a  a ", out_type=str)[0][0] != MARK:
            raise ValueError("pieces of this model cross whitespace markers, or it does not mark the first word")
        self.cache = WordCache(self.segment, entries, longest)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def segment(self, keys: list[str]) -> list[tuple[bytes, str]]:
        """Ids and text of each key. A lone marker is what the library drops from an otherwise empty text."""
        lone = [self.sp.piece_to_id(MARK)]
        coded = [ids if key else lone for key, ids in zip(keys, self.sp.encode(keys, num_threads=1), strict=True)]
        texts = self.sp.decode(coded, num_threads=1)
        return [(array("i", ids).tobytes(), " " + text) for ids, text in zip(coded, texts, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        parts = [self.chunks(t) for t in texts]
        table = self.cache.fetch(set().union(*parts))
        for p in parts:
            got = [table[c] for c in p]
            yield b"".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]


def sp_encode(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), slice_rows: int = 250) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` and ``decoded string`` for every row of ``docs``.

    ``model`` is the vocabulary file's path, which must be readable on the workers (installed there or sent with
    ``addFile``). Memory of a worker: its table and ``slice_rows`` texts.
    """
    if {"ids", "decoded"} & set(keep):
        raise ValueError("ids and decoded are columns that sp_encode adds")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches):
        table = ChunkTable(model)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                ids, texts = [], []
                for raw, text in table.encode(b.column(len(keep)).to_pylist()):
                    ids.append(raw)
                    texts.append(text)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists, pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sp_encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

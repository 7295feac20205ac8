"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one, and columns other than those of documents are dropped, whatever
their names. Nulls, empty and very long texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language_id, mix, near_copies, sp_codec
from millrace.llm.rows import documents, row_tag
from millrace.plans.durable import broadcast_if_small, durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language; documents in which none is recognised go.

    Those are null and empty texts and texts without a letter, and all, if no row has a language. Null ids and repeated rows are rows as others.
    """
    model = language_id.fit(docs, _vocabulary())
    found = language_id.identify(docs, model, keep=tuple(COLUMNS))
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in blanks only, the row with the most characters stays, then the smallest id (null last).

    A null text is an empty one. Of rows equal in id and text one stays, whatever their other columns.
    """
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are those that share 0.8 of their five-word shingles; op9's fingerprints reach a few of them only.

    Of what is linked, however indirectly, the row of the smallest id stays (null last). Texts without words are alike, null ones too; texts of
    fewer than five words are alike if all their words are. Of rows equal in id and text one stays.
    """
    return near_copies.drop_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three times.

    A null source is a source of its own. A text without words is taken or not as its number has it, and adds nothing to its source. Rows equal
    in id, source and text share what was taken of them.
    """
    keys = [F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("tag").alias("t")]
    # rows equal in id, source and text share what was taken of them
    copies = durable(mix.mix(docs).groupBy(*keys).agg(F.sum("copies").alias("all"), F.count("*").alias("rows")))
    here = docs.select(*COLUMNS).withColumn("row_tag_", row_tag())
    if copies.filter("rows > 1").limit(1).count():
        here = here.dropDuplicates(["doc_id", "source", "row_tag_"])
    copies = broadcast_if_small(copies.filter("all > 0").select("i", "s", "t", "all"), 200_000)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("row_tag_") == F.col("t"))
    taken = here.join(copies, same).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("all"))))
    return taken.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every row; a null or empty text has no ids. Null ids and repeated rows are rows as others."""
    ids = sp_codec.sp_encode(docs, _vocabulary(), keep=("doc_id", "source"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the fingerprints nor the vocabulary's segmentation; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

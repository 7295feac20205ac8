"""Operators over structured streams.

Operators that look at one row at a time make no action and no shuffle, so they run on a stream as they are. Those that need
the whole relation (samples, reducers, deduplicators) are refused; exact duplicates have a streaming form of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import millrace.operators  # noqa: F401
from millrace.plans.pipeline import apply
from millrace.plans.registry import BUILT_IN

#: Table operators that look at one row at a time.
ROW_LOCAL = frozenset({
    "explode", "field_type_converter", "edit_distance_mapper", "duplicate_ngram_chr_fraction_mapper", "top_ngram_chr_fraction_mapper", "url_component_extraction_mapper",
    "language_identification_mapper", "fasttext_model_mapper", "mask_pii_mapper", "litellm_mapper", "sensitive_doc_filter", "trash_host_filter",
})


def over_stream(stream: DataFrame, steps: Iterable[dict]) -> DataFrame:
    """``steps`` one after another on a streaming frame."""
    for step in steps:
        op = BUILT_IN[step["op_name"]]
        if op.kind not in ("map", "filter") and op.name not in ROW_LOCAL or any(step.get(k) for k in ("limit", "cache", "count", "show")):
            raise ValueError(f"{op.name} with these parameters needs the whole relation and can't run on a stream")
        stream = apply(op, op.spec(**{**step, "input_df": "df"}), stream.sparkSession, {"df": stream})
    return stream


def dedup_stream(stream: DataFrame, field: str, event_time: str, within: str) -> DataFrame:
    """The first row of each value of ``field``; state is kept for ``within`` behind the watermark."""
    keyed = stream.withWatermark(event_time, within).withColumn("gid", F.sha2(F.col(f"`{field}`").cast("binary"), 256))
    return keyed.dropDuplicatesWithinWatermark(["gid"])

"""Row filters. Each gives a boolean column; what becomes of it is the pipeline's ``mode``."""

from __future__ import annotations

import json
import operator as op
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.lists import read_text
from millrace.functions.quality import clean_share
from millrace.plans.registry import operator


@operator("length_filter", "filter")
def length_filter(df: DataFrame, col: Column, min_length: int | None = None, max_length: int | None = None) -> Column:
    """Length in code points within the bounds, both included; null passes."""
    n = F.length(col)
    bounds = [n >= min_length] if min_length is not None else []
    bounds += [n <= max_length] if max_length is not None else []
    return F.coalesce(reduce(op.and_, bounds), F.lit(True)) if bounds else F.lit(True)


@operator("numeric_filter", "filter")
def numeric_filter(df: DataFrame, col: Column, threshold: float, operator: str = "gt") -> Column:
    """Comparison with a number: lt, gt, le, ge or eq; null passes, NaN does not."""
    compare = {"lt": op.lt, "gt": op.gt, "le": op.le, "ge": op.ge, "eq": op.eq}
    if operator not in compare:
        raise ValueError(f"operator must be one of {sorted(compare)}")
    kind = df.select(col.alias("c")).schema["c"].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"numeric_filter takes numbers, not {kind.simpleString()}")
    test = compare[operator](col, F.lit(threshold))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        test = test & ~F.isnan(col)
    return F.coalesce(test, F.lit(True))


@operator("substring_contain_filter", "filter")
def substring_contain_filter(df: DataFrame, col: Column, substring: str | None = None) -> Column:
    """The field contains the substring, case-sensitively; null does not pass."""
    return F.contains(col, F.lit(substring).cast("string"))


@operator("null_rows_filter", "filter")
def null_rows_filter(df: DataFrame, col: Column, fields: list[str] | None = None) -> Column:
    """No null in ``fields``, or in any column where it is left out."""
    names = df.columns if fields is None else fields
    return reduce(op.and_, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(True))


@operator("garbled_text_filter", "filter", tag_field="is_garbled", reverse=True)
def garbled_text_filter(df: DataFrame, col: Column, threshold: float = 0.5, label_prefix: str = "__label__") -> Column:
    """Whether the text is garbled: less than ``threshold`` of it looks like text. Null and empty are not; filtering keeps the others.

    In place of a downloaded model: the share of characters other than mojibake, replacement marks and lone symbols.
    """
    return F.when(F.length(col) > 0, clean_share(col) < threshold).otherwise(F.lit(False))


def _keywords(paths: list[str]) -> list[str]:
    words: dict[str, None] = {}
    for path in paths:
        try:
            found = json.loads(read_text(path))
        except OSError as e:
            raise ValueError(f"keyword file {path!r} can't be read") from e
        if not isinstance(found, list) or not all(isinstance(w, str) for w in found):
            raise ValueError(f"keyword file {path!r} must hold a JSON list of strings")
        words |= dict.fromkeys(w for w in found if w)
    return list(words)


HITS = T.ArrayType(T.StructType([T.StructField("keyword", T.StringType()), T.StructField("start_index", T.IntegerType()), T.StructField("end_index", T.IntegerType())]))


def keyword_hits(col: Column, words: list[str]) -> Column:
    """All occurrences, overlapping ones too, with inclusive ends. The automaton is built once in a worker."""

    @F.pandas_udf(HITS)
    def find(batches: "pd.Series") -> "pd.Series":
        auto = _automaton(tuple(words))
        return batches.map(lambda t: None if t is None else [{"keyword": w, "start_index": e - len(w) + 1, "end_index": e} for e, w in (auto.iter(t) if len(words) else ())])

    return find(col)


_automata: dict = {}


def _automaton(words: tuple[str, ...]):
    if words not in _automata:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in words:
            auto.add_word(w, w)
        auto.make_automaton()
        _automata.clear()
        _automata[words] = auto
    return _automata[words]


@operator("sensitive_doc_filter", "table")
def sensitive_doc_filter(
    df: DataFrame, field: str, sensitive_keyword_paths: list[str], keyword_limits: int = 1, targeted_keywords_field: str | None = None, mode: str = "filter", tag_field: str = "tag"
) -> DataFrame:
    """At most ``keyword_limits`` occurrences of listed keywords, overlapping ones counted. A null field does not pass, unless
    ``targeted_keywords_field`` names a column to keep the hits in.
    """
    from millrace.plans.pipeline import tagged

    if mode not in ("tag", "filter", "tag_and_filter"):
        raise ValueError(f"unknown mode {mode!r}")
    col, words = F.col(f"`{field}`"), _keywords(sensitive_keyword_paths)
    if targeted_keywords_field:
        df = df.withColumn(targeted_keywords_field, keyword_hits(col, words))
        few = F.coalesce(F.size(F.col(targeted_keywords_field)) <= keyword_limits, F.lit(True))
        return tagged(df, tag_field, few, mode)

    @F.pandas_udf("int")
    def count(texts: "pd.Series") -> "pd.Series":
        auto = _automaton(tuple(words))
        return texts.map(lambda t: 0 if t is None else sum(1 for _ in (auto.iter(t) if len(words) else ())))

    return tagged(df, tag_field, F.when(col.isNull(), F.lit(False)).otherwise(count(col) <= keyword_limits), mode)


def _hosts(paths: list[str]) -> list[str]:
    """Hosts files (by name) hold ``0.0.0.0 host`` lines; any other file is a JSON list."""
    hosts: set[str] = set()
    for path in paths:
        text = read_text(path)
        if re.search(r"(KADhosts|FadeMindhosts)", path.rsplit("/", 1)[-1]):
            hosts |= {line.split()[-1] for line in text.splitlines() if line.startswith("0.0.0.0") and len(line.split()) > 1}
        else:
            hosts |= set(json.loads(text))
    return sorted(hosts)


@operator("trash_host_filter", "table")
def trash_host_filter(df: DataFrame, field: str, trash_host_paths: list[str], bloom_error_rate: float = 0.001, bloom_capacity: int | None = None, mode: str = "filter", tag_field: str = "tag") -> DataFrame:
    """The host in ``field`` is not listed; null passes. Exact: the list is joined, so there are no false positives.

    The Bloom parameters are checked and otherwise unused. Lists of up to a million hosts are broadcast.
    """
    from millrace.plans.durable import broadcast_if_small
    from millrace.plans.pipeline import tagged

    hosts = _hosts(trash_host_paths)
    if not 0 < bloom_error_rate < 1:
        raise ValueError("bloom_error_rate must lie between 0 and 1")
    if not hosts:
        raise ValueError("the host lists are empty")
    if bloom_capacity is not None and bloom_capacity < len(hosts):
        raise ValueError("bloom_capacity is less than the number of hosts")
    listed = df.sparkSession.createDataFrame(pd.DataFrame({"trash_host_": hosts})).withColumn("is_trash_", F.lit(True))
    joined = df.join(broadcast_if_small(listed, 1_000_000), F.col(f"`{field}`") == F.col("trash_host_"), "left")
    out = tagged(joined, tag_field, F.col("is_trash_").isNull(), mode)
    return out.drop("trash_host_", "is_trash_")

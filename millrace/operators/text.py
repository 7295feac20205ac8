"""Text mappers: built-in functions where they say exactly what is meant, else Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.registry import operator


@operator("text_length_mapper", "map")
def text_length_mapper(df: DataFrame, col: Column) -> Column:
    """Length in code points; null stays null."""
    return F.length(col)


@operator("character_normalization_mapper", "map")
def character_normalization_mapper(df: DataFrame, col: Column) -> Column:
    """Unicode NFKC; empty becomes null. ASCII texts are their own form and don't leave the JVM's columns."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t else None)

    return F.when(col.rlike(r"^[\x00-\x7F]+$"), col).otherwise(nfkc(F.when(~col.rlike(r"^[\x00-\x7F]+$"), col)))


@operator("character_removal_mapper", "map")
def character_removal_mapper(df: DataFrame, col: Column, characters_to_remove: str = "") -> Column:
    """Deletes each of the listed characters."""
    return F.translate(col, characters_to_remove, "") if characters_to_remove else col


@operator("unprintable_char_remove_mapper", "map")
def unprintable_char_remove_mapper(df: DataFrame, col: Column, exclude_chars: str = "\n") -> Column:
    """Keeps printable characters and ``exclude_chars``. Plain ASCII without control characters is passed as it is."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isprintable() else "".join([c for c in t if c.isprintable() or c in exclude_chars]))

    plain = col.rlike(r"^[\x20-\x7E]*$")
    return F.when(plain, col).otherwise(clean(F.when(~plain, col)))


@operator("filter_line_by_regex_mapper", "map")
def filter_line_by_regex_mapper(df: DataFrame, col: Column, regex: str) -> Column:
    """Drops the lines in which the expression is found. Classes such as ``\\d`` are Unicode ones."""
    re.compile(regex)
    return F.array_join(F.filter(F.split(col, "\n", -1), lambda line: ~line.rlike(f"(?U){regex}")), "\n")


@operator("edit_distance_mapper", "table")
def edit_distance_mapper(df: DataFrame, fields: list[str], output_field: str) -> DataFrame:
    """Levenshtein distance of two columns in code points; null if either is null or empty."""
    if len(fields) != 2:
        raise ValueError("edit_distance_mapper takes two fields")
    a, b = (F.col(f"`{c}`") for c in fields)
    return df.withColumn(output_field, F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(a, b)))


def _repeated_share(col: Column, separator: str) -> Column:
    parts = F.split(col, separator, -1)
    total = F.length(col) - (F.size(parts) - 1) * len(separator)
    share = (total - F.length(F.array_join(F.array_distinct(parts), ""))) / F.length(col)
    return F.when(F.length(col) == 0, F.lit(0.0)).otherwise(share).cast("float")


@operator("duplicate_line_chr_fraction_mapper", "map")
def duplicate_line_chr_fraction_mapper(df: DataFrame, col: Column) -> Column:
    """Share of the characters that are in lines said before; 32-bit."""
    return _repeated_share(col, "\n")


@operator("duplicate_paragraph_chr_fraction_mapper", "map")
def duplicate_paragraph_chr_fraction_mapper(df: DataFrame, col: Column) -> Column:
    """Share of the characters that are in paragraphs said before; 32-bit."""
    return _repeated_share(col, "\n\n")


def gram_numbers(text: str, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the rising ``sizes``, the n-gram that starts at each position, numbered by first occurrence; exact, without hashing.

    Characters are numbered first, so that an n-gram is a whole number of few bits. One that 63 bits don't hold is the pair of two
    shorter ones, which together cover it.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = pd.factorize(codes)[0].astype(np.int64)
    bits = max(1, int(letters.max(initial=0)).bit_length())
    width, packed, known = 1, letters, {1: letters}
    for n in range(1, max(sizes) + 1):
        if len(text) < n:
            return
        if n * bits <= 63:
            if n > 1:
                packed = (packed[:-1] << bits) | letters[n - 1 :]
            width = n
            if n in sizes or n * bits + bits > 63 or 2 * n >= max(sizes):
                known[n] = pd.factorize(packed)[0]
        elif n in sizes or n == 2 * max(known):
            half = max(known)
            left, right = known[half][: len(text) - n + 1], known[half][n - half :]
            known[n] = pd.factorize(left * (int(known[half].max()) + 1) + right)[0]
        if n in sizes:
            yield n, known[n]


def covered(numbers: np.ndarray, n: int, length: int, top: bool) -> float:
    """Share of the characters within n-grams that occur more than once, or within those of the most frequent one (the first of them)."""
    counts = np.bincount(numbers)
    starts = numbers == np.argmax(counts) if top else counts[numbers] > 1
    edge = np.zeros(length + 1, np.int8)
    edge[: len(starts)] += starts
    edge[n:] -= starts
    return float(np.count_nonzero(np.cumsum(edge, dtype=np.int32)[:-1]) / length)


def gram_shares(text: str, sizes: list[int], top: bool) -> list[float]:
    found = {n: covered(numbers, n, len(text), top) for n, numbers in gram_numbers(text, sizes)} if text else {}
    return [found.get(n, 0.0) for n in sizes]


def _gram_shares(df: DataFrame, field: str, ngram_range: tuple[int, int], name: str, top: bool) -> DataFrame:
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("ngram_range must be (low, high) with 1 <= low <= high")
    sizes = list(range(low, high + 1))
    names = [name.format(n) for n in sizes]

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def shares(texts: pd.Series) -> pd.DataFrame:
        rows = [[None] * len(sizes) if t is None else gram_shares(t, sizes, top) for t in texts]
        return pd.DataFrame(rows, columns=names, dtype="float64")

    out = df.withColumn("shares_", shares(F.col(f"`{field}`")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"shares_.{c}").alias(c) for c in names))


@operator("duplicate_ngram_chr_fraction_mapper", "table")
def duplicate_ngram_chr_fraction_mapper(df: DataFrame, field: str, ngram_range: tuple[int, int] = (5, 10)) -> DataFrame:
    """For each n: share of the characters in repeated character n-grams. Null stays null, shorter texts give 0."""
    return _gram_shares(df, field, ngram_range, "dup_{}_ngram_chr_fraction", False)


@operator("top_ngram_chr_fraction_mapper", "table")
def top_ngram_chr_fraction_mapper(df: DataFrame, field: str, ngram_range: tuple[int, int] = (3, 5)) -> DataFrame:
    """For each n: share of the characters in occurrences of the most frequent character n-gram. Null stays null, shorter texts give 0."""
    return _gram_shares(df, field, ngram_range, "top_{}_gram_chr_fraction", True)

"""How much of a text looks like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_share(col: Column) -> Column:
    """Share of a text's tokens (by blanks) that hold no mojibake, all in built-in functions.

    Mojibake: replacement and control characters, or a token of nothing but Latin-1 supplement and symbol characters.
    """
    tokens = F.filter(F.split(col, r"\s+"), lambda t: t != "")
    odd = F.filter(tokens, lambda t: t.rlike("[�\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f]") | t.rlike("^[¡-ÿĀ-ſ]{1,2}$") & ~t.rlike("^[àáéóòèÀÉÓ«»¿¡°]$"))
    odd_chars = F.aggregate(odd, F.lit(0), lambda a, t: a + F.length(t))
    all_chars = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t))
    return F.when(all_chars > 0, 1 - odd_chars / all_chars).otherwise(1.0)

"""Operators around models: language, generic classifiers, personal data, remote language models."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from bisect import bisect_left
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.chat_client import ChatClient, as_json, retried
from millrace.functions.label_model import GramScores
from millrace.functions.lists import read_text
from millrace.functions.names import NRP, PERSON, place_names, places
from millrace.operators.web import _DATE
from millrace.plans.parts import in_parts
from millrace.plans.registry import operator

#: Scripts that speak for one language, as regular expressions.
SCRIPTS = {
    "ja": "[぀-ヿ]", "ko": "[가-힯ᄀ-ᇿ]", "zh": "[一-鿿]", "ar": "[؀-ۿ]", "ru": "[Ѐ-ӿ]", "el": "[Ͱ-Ͽ]",
    "he": "[֐-׿]", "th": "[฀-๿]", "hi": "[ऀ-ॿ]",
}
#: Frequent short words of languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is was for that it with as on are you how this be by at from he she not have",
    "fr": "le la les de des du et un une est dans que qui pour pas sur au aux avec ce il elle nous vous comment tu je ne",
    "de": "der die das und ist in den von zu mit sich des auf für ein eine nicht im dem auch es wie ich sie",
    "es": "el la los las de y en que un una es por con para del se no al lo como más está qué",
    "it": "il lo la gli di e che un una è per con del della non si da come sono",
    "pt": "o os as de e que um uma é para com do da não em se por como mais",
    "nl": "de het een en van is in dat op te zijn met voor niet aan er hoe",
}
_LETTERS = {k: re.compile(v) for k, v in SCRIPTS.items()}
_WORD_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Letters that speak for one of these languages.
_MARKS = {"fr": "àâçèêëîïôùûœ", "de": "äöüß", "es": "ñ¿¡áíóú", "pt": "ãõ"}


def language_of(text: str) -> tuple[str, float]:
    """Label and share: Kana before Han, then other scripts by their letters, then frequent words and marks."""
    text = text.replace("\n", " ")
    letters = sum(c.isalpha() for c in text) or 1
    scripts = {k: len(p.findall(text)) for k, p in _LETTERS.items()}
    if scripts["ja"] * 10 >= letters:
        return "ja", min(1.0, (scripts["ja"] + scripts["zh"]) / letters)
    top = max(scripts, key=scripts.get)
    if 2 * scripts[top] >= letters or scripts[top] > 0 and not re.search("[A-Za-z]", text):
        return top, min(1.0, scripts[top] / letters)
    words = re.findall(r"[^\W\d_]+", text.lower())
    points = {k: sum(w in s for w in words) + 0.5 * sum(text.count(c) for c in _MARKS.get(k, "")) for k, s in _WORD_SETS.items()}
    best = max(points, key=points.get)
    return (best, (points[best] + 0.1) / (sum(points.values()) + 0.1 * len(points))) if points[best] else ("en", 1 / len(points))


def _label_and_prob(df: DataFrame, field: str, output_field: str, prob_field: str, predict) -> DataFrame:
    """``predict``: labels and probabilities of a list of texts."""

    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        found = iter(predict([t for t in given if t is not None]))
        rows = [(None, None) if t is None else next(found) for t in given]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["label", "prob"])

    made = df.withColumn("made_", in_parts("label string, prob double", run)(F.col(f"`{field}`")))
    return made.withColumn(output_field, F.col("made_.label")).withColumn(prob_field, F.col("made_.prob")).drop("made_")


@lru_cache(2)
def _fasttext(path: str):
    try:
        import fasttext
    except ImportError as e:
        raise ValueError("fastText models need the fasttext library; give a JSON model instead") from e
    from pyspark import SparkFiles

    here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    model = fasttext.load_model(here)
    return lambda t: (lambda r: (r[0][0], float(r[1][0])))(model.predict(t))


@lru_cache(2)
def _classifier(model: str):
    return GramScores(json.loads(model))


def _predictor(df: DataFrame, model_path: str, label_prefix: str):
    """A function of a list of texts for the workers; a JSON model is read here and sent to them."""
    binary = model_path.endswith((".bin", ".ftz"))
    sent = None if binary else df.sparkSession.sparkContext.broadcast(read_text(model_path))

    def predict(texts):
        plain = [t.replace("\n", "") for t in texts]
        found = list(map(_fasttext(model_path), plain)) if binary else _classifier(sent.value)(plain)
        return [(label.removeprefix(label_prefix), prob) for label, prob in found]

    return predict


@operator("language_identification_mapper", "table")
def language_identification_mapper(df: DataFrame, field: str, output_field: str, prob_field: str = "language_prob", label_prefix: str = "__label__", model_path: str | None = None) -> DataFrame:
    """Language and its probability; null gives nulls. By ``model_path``, as in ``fasttext_model_mapper``, or else from scripts, frequent words and letters."""
    return _label_and_prob(df, field, output_field, prob_field, _predictor(df, model_path, label_prefix) if model_path else lambda texts: list(map(language_of, texts)))


@operator("fasttext_model_mapper", "table")
def fasttext_model_mapper(df: DataFrame, field: str, output_field: str, model_path: str, prob_field: str, label_prefix: str = "__label__") -> DataFrame:
    """The first label of a classifier and its probability; null gives nulls.

    ``model_path``: a fastText ``.bin`` or ``.ftz`` where that library is installed, at that path on the workers or sent by ``addFile``; else a JSON
    model, such as ``fit_label_model`` makes. Either is loaded once in a worker.
    """
    if not isinstance(df.schema[field].dataType, T.StringType):
        raise ValueError(f"{field} must be a string column")
    return _label_and_prob(df, field, output_field, prob_field, _predictor(df, model_path, label_prefix))


#: Chinese telephone and identity numbers, which need a character on both sides.
ZH_PATTERNS = {
    "ZH_PHONE_NUMBER": r"(?<=[^\d])(((\+86)?([- ])?)?((1[3-9][0-9]))([- ])?\d{4}([- ])?\d{4})(?=[^\d])",
    "ZH_LANDLINE_NUMBER": r"(?<=[^\d])(([\(（])?0\d{2,3}[\)） —-]{1,2}\d{7,8}|\d{3,4}[ -]\d{3,4}[ -]\d{4})(?=[^\d])",
    "ZH_ID_CARD": r"(?<=[^0-9a-zA-Z])((1[1-5]|2[1-3]|3[1-7]|4[1-6]|5[0-4]|6[1-5]|71|81|82|91)(0[0-9]|1[0-9]|2[0-9]|3[0-9]|4[0-3]|5[1-3]|90)(0[0-9]|1[0-9]|2[0-9]|3[0-9]|4[0-3]|5[1-7]|6[1-4]|7[1-4]|8[1-7])(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])\d{3}[0-9xX])(?=[^0-9a-zA-Z])",
}


def _luhn(s: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _nhs(s: str) -> bool:
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return len(d) == 10 and (11 - sum(x * (10 - i) for i, x in enumerate(d[:9])) % 11) % 11 == d[9]


#: Entity -> (priority in overlaps, expression, further test).
ENTITIES: dict[str, tuple[float, re.Pattern, Any]] = {
    **{k: (1.0, re.compile(v), None) for k, v in ZH_PATTERNS.items()},
    "EMAIL_ADDRESS": (1.0, re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"), None),
    "CREDIT_CARD": (1.0, re.compile(r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"), _luhn),
    "IBAN_CODE": (1.0, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    "CRYPTO": (0.9, re.compile(r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34}|0x[0-9a-fA-F]{40})\b"), None),
    "IP_ADDRESS": (0.8, re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"), None),
    "US_SSN": (0.7, re.compile(r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"), None),
    "US_ITIN": (0.7, re.compile(r"\b9\d{2}-(?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])-\d{4}\b"), None),
    "UK_NHS": (0.7, re.compile(r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b"), _nhs),
    "MEDICAL_LICENSE": (0.6, re.compile(r"\b[A-Za-z]{2}\d{7}\b"), None),
    "URL": (0.6, re.compile(r"\b(?:https?|ftp)://[^\s<>\"'，。；！？、）】]+|\bwww\.[^\s<>\"'，。；！？、）】]+", re.IGNORECASE), None),
    "DATE_TIME": (0.6, _DATE, None),
    "PHONE_NUMBER": (0.4, re.compile(r"(?<![\w.+-])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), None),
    "US_PASSPORT": (0.3, re.compile(r"\b[A-Z]\d{8}\b"), None),
    "US_DRIVER_LICENSE": (0.3, re.compile(r"\b[A-Z]\d{7}\b"), None),
    "US_BANK_NUMBER": (0.1, re.compile(r"\b\d{8,17}\b"), None),
}
#: By rules and lists (``functions/names.py``): what follows a title or an introduction, countries and cities, nationalities and faiths.
ENTITIES |= {"PERSON": (0.85, PERSON, lambda name: name[0].isupper()), "NRP": (0.85, NRP, None)}
PLACE = "LOCATION"


def _written(found: str, entity: str, config: dict | None) -> str:
    if config is None:
        return f"<{entity}>" if entity in ZH_PATTERNS else "<ANONYMIZED>"
    kind = config["type"]
    if kind == "replace":
        return config.get("new_value", f"<{entity}>")
    if kind == "redact":
        return ""
    if kind == "keep":
        return found
    if kind == "hash":
        return hashlib.new(config.get("hash_type", "sha256"), found.encode()).hexdigest()
    n, c = min(int(config.get("chars_to_mask", len(found))), len(found)), str(config.get("masking_char", "*"))
    return found[: len(found) - n] + c * n if config.get("from_end", False) else c * n + found[n:]


def mask(text: str, mask_map: dict[str, dict | None], place_names: tuple[str, ...] = ()) -> str:
    """Detects the entities of ``mask_map`` and writes them anew; where two overlap the stronger, then the longer, stands."""
    found = []
    for entity in mask_map:
        weight, pattern, test = (0.85, places(place_names), None) if entity == PLACE else ENTITIES[entity]
        # of some patterns only a part is the entity
        part = "it" if "it" in pattern.groupindex else 0
        found += [(-weight, m.start(part) - m.end(part), *m.span(part), entity) for m in pattern.finditer(text) if test is None or test(m[part])]
    kept: list[tuple[int, int, str]] = []  # in order of place, none overlapping another
    for _, _, a, z, entity in sorted(found):
        i = bisect_left(kept, (z,))
        if not i or kept[i - 1][1] <= a:
            kept.insert(i, (a, z, entity))
    out, at = [], 0
    for a, z, entity in kept:
        out += [text[at:a], _written(text[a:z], entity, mask_map[entity])]
        at = z
    return "".join(out) + text[at:]


@operator("mask_pii_mapper", "table")
def mask_pii_mapper(df: DataFrame, field: str, output_field: str, mask_map: dict[str, Any], engine_name: str | None = None) -> DataFrame:
    """Personal data replaced, redacted, masked, hashed or kept, by entity. Names of people, places and groups are found by rules and lists only."""
    configs: dict[str, dict | None] = {}
    for entity, config in mask_map.items():
        if entity not in ENTITIES and entity != PLACE:
            raise ValueError(f"unknown entity {entity!r}")
        try:
            config = json.loads(config) if isinstance(config, str) else config
        except ValueError as e:
            raise ValueError(f"mask_map[{entity!r}] is not valid JSON") from e
        if config is not None and (not isinstance(config, dict) or config.get("type") not in ("replace", "redact", "mask", "hash", "keep")):
            raise ValueError(f"mask_map[{entity!r}] needs a type: replace, redact, mask, hash or keep")
        configs[entity] = config

    names = place_names(df.sparkSession) if PLACE in configs else ()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask(t, configs, names))

    return df.withColumn(output_field, run(F.col(f"`{field}`")))


@operator("litellm_mapper", "table")
def litellm_mapper(
    df: DataFrame, field: str, output_field: str, model_name: str, api_key: str, prompt_template: str, base_url: str | None = None, temperature: float = 0.2, max_tokens: int | None = None,
    max_retries: int = 3, frequency_penalty: float | None = None, return_format: str = "text", answer_flatten: bool = False, answer_schema: str | None = None, client: Any = None, concurrency: int = 8,
) -> DataFrame:
    """The answer of a remote language model to a prompt filled in from each row.

    ``return_format`` json keeps the JSON found in the answer (or the answer itself). ``answer_schema`` (DDL) declares what a
    JSON answer holds; with ``answer_flatten`` its fields become columns. ``client``: a picklable function that makes a client in
    the worker. Each task has ``concurrency`` questions under way at once.
    """
    if return_format not in ("json", "text"):
        raise ValueError("return_format must be json or text")
    if answer_flatten and not answer_schema:
        raise ValueError("answer_flatten needs answer_schema")
    if m := re.fullmatch(r"\$\{(\w+)\}", api_key):
        api_key = os.environ.get(m[1], "")
        if not api_key:
            raise ValueError(f"environment variable {m[1]} is not set")
    make = client or (lambda: ChatClient(model_name, api_key, base_url, temperature, max_tokens, frequency_penalty, max_retries=0))

    @F.pandas_udf("string")
    def ask(rows: pd.DataFrame) -> pd.Series:
        chat = make()

        def answer(row: dict) -> str:
            found = retried(lambda: chat.complete(prompt_template.format(**row)), max_retries, lambda attempt: min(10, 4 * 2**attempt))
            return found if return_format == "text" else as_json(found) or found

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            return pd.Series(list(pool.map(answer, rows.to_dict("records"))), dtype=object)

    out = df.withColumn(output_field, ask(F.struct("*")))
    if return_format == "json" and answer_schema:
        parsed = F.from_json(output_field, answer_schema)
        if answer_flatten:
            names = T._parse_datatype_string(answer_schema).names
            out = out.withColumn("parsed_", parsed).select(*(F.col(f"`{c}`") for c in df.columns if c not in names), *(F.col(f"parsed_.`{c}`") for c in names))
        else:
            out = out.withColumn(output_field, parsed)
    return out

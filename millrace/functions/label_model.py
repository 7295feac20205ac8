"""Fitting a text classifier that ``fasttext_model_mapper`` applies, where no trained one is at hand.

Character n-grams with the weights of a multinomial naive Bayes model: for each label, the logarithms of its share of an n-gram relative to that
n-gram's share over all labels. What is kept is bounded by ``most`` n-grams, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.parts import parts


#: Characters whose n-grams a task counts at once.
HELD_CHARACTERS = 2_000_000
#: Cells of a table in place of which keys are sorted.
DENSE = 1 << 22


def _flat(texts: list[str], pad: int) -> tuple[str, np.ndarray]:
    """The texts, which hold no line ends, with ``pad`` line ends after each; the same as code points."""
    joined = "".join(t + "\n" * pad for t in texts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(texts: list[str], low: int, high: int):
    """(n-gram, how often it is in all the texts) for n from ``low`` to ``high``; the texts hold no line ends."""
    if not texts:
        return
    joined, codes = _flat(texts, max(1, high - 1))
    is_pad = codes == 10
    letters, keys = np.unique(codes, return_inverse=True)
    first, k, span = keys.astype(np.int64), len(letters), len(letters)
    keys = first
    for n in range(1, high + 1):
        if n > 1:
            if span > 2**62 // k:
                span, keys = (lambda u: (len(u[0]), u[1].astype(np.int64)))(np.unique(keys, return_inverse=True))
            keys = keys[:-1] * k + first[n - 1 :]
            span *= k
        if n < low:
            continue
        at = np.flatnonzero(~(is_pad[: len(keys)] | is_pad[n - 1 :]))
        own = keys[at]
        if span <= min(DENSE, 8 * len(own)):
            counts, place = np.bincount(own, minlength=span), np.empty(span, np.int64)
            place[own] = at
            met = np.flatnonzero(counts)
            counts, place = counts[met], place[met]
        else:
            _, place, counts = np.unique(own, return_index=True, return_counts=True)
            place = at[place]
        yield from zip([joined[i : i + n] for i in place.tolist()], counts.tolist(), strict=True)


class GramScores:
    """Labels and probabilities by ``{"ngrams": [low, high], "bias": {label: b}, "weights": {label: {gram: w}}}``, of many texts at once.

    The n-grams are a tree; a table leads from a node and a character to the node below, 0 being none.
    """

    def __init__(self, spec: dict):
        self.low, self.high = spec.get("ngrams", [1, 3])
        self.labels = sorted(spec["weights"])
        self.bias = np.array([spec.get("bias", {}).get(k, 0.0) for k in self.labels])
        grams = sorted({g for w in spec["weights"].values() for g in w if self.low <= len(g) <= self.high and "\n" not in g})
        self.letters = np.array(sorted({ord(c) for g in grams for c in g}), np.uint32)
        code = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        self.k, above = len(code) + 1, {"": 1}
        self.steps, self.weights = [], []
        for n in range(1, self.high + 1):
            nodes = {p: i + 1 for i, p in enumerate(sorted({g[:n] for g in grams if len(g) >= n}))}
            keys = np.array([above[p[:-1]] * self.k + code[p[-1]] for p in nodes], np.int64)
            span, order = (len(above) + 1) * self.k, np.argsort(keys)
            table = None
            if span <= DENSE:
                table = np.zeros(span, np.int32)
                table[keys] = np.arange(1, len(nodes) + 1)
            self.steps.append((table, keys[order], order + 1))
            self.weights.append([np.array([0.0, *(spec["weights"][label].get(p, 0.0) for p in nodes)]) for label in self.labels] if n >= self.low else None)
            above = nodes

    def _below(self, n: int, keys: np.ndarray) -> np.ndarray:
        table, known, nodes = self.steps[n]
        if table is not None:
            return table[keys]
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, nodes[at], 0)

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """The texts hold no line ends."""
        if not texts:
            return []
        pad = max(1, self.high - 1)
        _, codes = _flat(texts, pad)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths + pad) - lengths - pad
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        ids = np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else np.zeros(len(codes), np.int64)
        sums = [np.zeros(len(codes)) for _ in self.labels]
        nodes = np.ones(len(codes), np.int64)
        for n in range(self.high):
            nodes = self._below(n, nodes[: len(codes) - n].astype(np.int64) * self.k + ids[n:])
            if self.weights[n] is not None:
                for total, w in zip(sums, self.weights[n], strict=True):
                    total[: len(nodes)] += w[nodes]
        size = np.maximum(1, sum(np.maximum(0, lengths - n + 1) for n in range(self.low, self.high + 1)))
        scores = np.stack([b + np.add.reduceat(total, starts) / size for b, total in zip(self.bias, sums, strict=True)], axis=1)
        best = scores.argmax(axis=1)
        probs = 1 / np.exp(scores - scores[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [(self.labels[i], p) for i, p in zip(best.tolist(), probs.tolist(), strict=True)]


def fit_label_model(df: DataFrame, field: str, label_field: str, ngrams: tuple[int, int] = (1, 3), most: int = 20_000, smoothing: float = 0.5, sharpness: float = 50.0) -> str:
    """The JSON of a model of ``label_field``; rows where it or the text is null are left out.

    Counts are of all rows, summed in each task and combined map-side; the ``most`` n-grams that most labelled texts have come to the driver.
    ``sharpness``: the length of text, in n-grams, after which probabilities stop growing more certain.
    """
    low, high = ngrams

    def count(batches):
        sums: Counter = Counter()
        held: dict[str, list[str]] = {}
        size = 0

        def add():
            nonlocal size
            for label, texts in held.items():
                for gram, c in gram_counts(texts, low, high):
                    sums[label, gram] += c
            held.clear()
            size = 0

        def out():
            keys = list(sums)
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())], names=["label", "gram", "n"])
            sums.clear()
            return made

        for whole in batches:
            for b in parts(whole):
                for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held.setdefault(label, []).append(text.replace("\n", ""))
                    sums[label, None] += 1
                    size += len(text)
                if size > HELD_CHARACTERS:
                    add()
                    if len(sums) > 200_000:
                        yield out()
        add()
        yield out()

    rows = df.select(F.col(f"`{label_field}`").cast("string").alias("label"), F.col(f"`{field}`").alias("text")).filter("label IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(count, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    by_gram = sums.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("label", "n")).alias("parts"))
    kept = by_gram.orderBy(F.col("gram").isNull().desc(), F.desc("all"), "gram").limit(most + 1).collect()
    docs = {p["label"]: p["n"] for r in kept if r["gram"] is None for p in r["parts"]}
    grams = [r for r in kept if r["gram"] is not None]
    totals = Counter()
    for r in grams:
        totals.update({p["label"]: p["n"] for p in r["parts"]})
    every = sum(totals.values())
    weights: dict[str, dict[str, float]] = {label: {} for label in docs}
    for r in grams:
        by_label = {p["label"]: p["n"] for p in r["parts"]}
        share = r["all"] / every
        for label in docs:
            own = (by_label.get(label, 0) + smoothing * share * len(grams)) / (totals[label] + smoothing * len(grams))
            weights[label][r["gram"]] = round(sharpness * math.log(own / share), 4)
    n = sum(docs.values())
    return json.dumps({"ngrams": [low, high], "bias": {k: math.log(v / n) for k, v in docs.items()}, "weights": weights}, ensure_ascii=False)

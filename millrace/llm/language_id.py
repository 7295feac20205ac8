"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. For each language, piece probabilities are estimated from the
labelled texts (counts of the vocabulary's own segmentation of every word, smoothed). A word's probability
in a language is the sum over all of its segmentations into pieces, by the forward algorithm, which
runs over many words of one length at once; a text's is the product over its words and the language's prior.
The prediction is the language of the greatest posterior, the score that posterior.

The model is a table of languages by pieces (32,000 or whatever the vocabulary has), whatever the corpus size; it
goes to the workers as a broadcast value of that proven bound.

Defined results: ``und`` with score 0 for a null text, one without letters, or if nothing was learnt; ties go to
the smaller language; texts are lower-cased; null ids and repeated rows are rows as others; other columns are
ignored; an empty table gives an empty one. Training skips null languages and null texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.rows import documents

MARK = "▁"
UNKNOWN = "und"
#: Bytes and rows of texts that are worked on at once.
SLICE, SLICE_ROWS = 4 << 20, 2000
#: Distinct words that are counted before they are segmented; words whose probabilities a task keeps.
COUNTED, KEPT = 150_000, 60_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(44)


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _slices(batches, column: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE_ROWS`` rows and about ``SLICE`` bytes of the texts in ``column``, one row at least."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            held = ends[at - 1] if at else 0
            end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, held + SLICE, "right"))))
            yield whole.slice(at, end - at)
            at = end


def piece_counts(labelled: DataFrame, model: str) -> DataFrame:
    """``lang, piece, n`` over all words of ``labelled(lang, text)``; each task sends its sums only."""

    def run(batches):
        sp = _processor(model)
        size = sp.get_piece_size()
        sums: dict[str, np.ndarray] = {}
        docs: Counter = Counter()
        words: dict[str, Counter] = {}

        def add():
            for lang, counts in words.items():
                parts = sp.encode(list(counts), num_threads=1)
                weights = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(p) for p in parts])
                ids = np.fromiter((i for p in parts for i in p), np.int32, len(weights))
                sums[lang] = sums.get(lang, 0) + np.bincount(ids, weights, minlength=size)
            words.clear()

        held = 0
        for b in _slices(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.lower().split())
                docs[lang] += 1
                held += len(text)
            if held > 16 * SLICE or sum(map(len, words.values())) > COUNTED:
                add()
                held = 0
        add()
        for lang in docs:
            pieces = np.flatnonzero(sums[lang])
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n + 1), pa.string()), pa.array([-1, *pieces.tolist()], pa.int32()), pa.array([docs[lang], *sums[lang][pieces].astype(np.int64).tolist()], pa.int64())],
                names=["lang", "piece", "n"],
            )

    texts = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return texts.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """``probs[p, l]``: probability of piece p in language l, with two rows more: unknown character, nothing."""

    langs: list[str]
    prior: np.ndarray
    probs: np.ndarray
    pieces: list[str]
    _index: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def index(self):
        """Sorted hashes of the pieces, their numbers, how many there are and where they begin for each value of the top bits, the longest piece."""
        if self._index is None:
            hashes = np.array([_hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)) for p in self.pieces], np.uint64)
            order = np.argsort(hashes)
            counts = np.bincount((hashes >> _TOP).astype(np.int64), minlength=1 << 20)
            known = np.concatenate([hashes[order], hashes[order][-1:].repeat(int(counts.max(initial=0)))])
            self._index = known, order, counts.astype(np.uint8), (np.cumsum(counts) - counts).astype(np.int32), max(map(len, self.pieces))
        return self._index

    def _numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are those of pieces, and of which."""
        known, order, counts, first, _ = self.index()
        top = (hashes >> _TOP).astype(np.int64)
        maybe = np.flatnonzero(counts[top])
        top, wanted = top[maybe], hashes[maybe]
        at, here = first[top], np.full(len(maybe), -1, np.int64)
        for k in range(int(counts[top].max(initial=0))):
            here = np.where(known[at + k] == wanted, at + k, here)
        found = here >= 0
        return maybe[found], order[here[found]]

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities (words, languages) of words of one length, given as code points (words, length)."""
        n, length = codes.shape
        longest = min(self.index()[-1], length)
        unknown = self.probs[-2]
        alpha = {0: np.ones((n, len(self.langs)))}
        scale = np.zeros(n)
        rolling: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            code = codes[:, end - 1].astype(np.uint64) + np.uint64(1)
            rolling[end - 1] = np.zeros(n, np.uint64)
            total = alpha[end - 1] * unknown
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                rolling[start] = rolling[start] * _BASE + code
                at, numbers = self._numbers(rolling[start] * _BASE)
                if not len(at):
                    continue
                if start == end - 1:
                    total[at] = alpha[start][at] * self.probs[numbers]
                else:
                    total[at] += alpha[start][at] * self.probs[numbers]
            alpha[end] = total
            gone = end - longest
            if gone >= 0:
                alpha.pop(gone, None)
                rolling.pop(gone, None)
            if end % 8 == 0:
                top = np.maximum(total.max(axis=1, keepdims=True), 1e-300)
                scale += np.log(top[:, 0])
                alpha = {k: a / top for k, a in alpha.items()}
        return np.log(np.maximum(alpha[length], 1e-300)) + scale[:, None]

    def _long(self, codes: np.ndarray, part: int = 1 << 16) -> np.ndarray:
        """The same for one long word, given as code points: the pieces of many places are looked up at once, then the sums go from place to place."""
        longest, length = min(self.index()[-1], len(codes)), len(codes)
        alpha, scale = np.zeros((longest + 1, len(self.langs))), 0.0
        alpha[0] = 1
        for begin in range(0, length, part):
            first, last = max(0, begin - longest + 1), min(length, begin + part)
            code = codes[first:last].astype(np.uint64) + np.uint64(1)
            h, found = np.zeros(len(code), np.uint64), []
            for k in range(1, min(longest, len(code)) + 1):
                h = h[: len(code) - k + 1] * _BASE + code[k - 1 :]
                at, numbers = self._numbers(h * _BASE)
                found.append((at + (first + k), at + first, numbers))
            ends, starts, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(ends, kind="stable")  # of one end, the shortest piece is first
            ends, starts, numbers = ends[order], starts[order], numbers[order]
            cuts = np.searchsorted(ends, np.arange(begin + 1, last + 2)).tolist()
            rows = starts % (longest + 1)
            for end, a, z in zip(range(begin + 1, last + 1), cuts[:-1], cuts[1:], strict=True):
                total = (alpha[rows[a:z]] * self.probs[numbers[a:z]]).sum(0)
                if a == z or starts[a] != end - 1:
                    total = total + alpha[(end - 1) % (longest + 1)] * self.probs[-2]
                alpha[end % (longest + 1)] = total
                if end % 8 == 0:
                    top = max(total.max(initial=0), 1e-300)
                    scale += np.log(top)
                    alpha /= top
        return np.log(np.maximum(alpha[length % (longest + 1)], 1e-300)) + scale

    def words(self, words: list[str], long: int = 256) -> np.ndarray:
        """Log-probabilities (words, languages)."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        out = np.zeros((len(words), len(self.langs)))
        for length, at in by_length.items():
            # so many words at once that the states of all places of the longest piece stay within 16 MB
            block = max(1, (2 << 20) // (max(1, len(self.langs)) * min(length, self.index()[-1])))
            for k in range(0, len(at), block):
                part = at[k : k + block]
                codes = np.frombuffer("".join([MARK + words[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                out[part] = [self._long(row) for row in codes] if length > long else self._forward(codes)
        return out


class _Rows:
    """The words that a task met lately and their log-probabilities: a row of ``logs`` for each."""

    def __init__(self, model: LanguageModel, kept: int = KEPT, longest: int = 64):
        self.model, self.kept, self.longest = model, kept, longest
        self.number: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))
        self.used = 0
        self.long: list[str] = []

    def meet(self, words: set[str]) -> None:
        """From now on ``number`` has all of ``words``; others may go, long ones do."""
        for w in self.long:
            del self.number[w]
        missing = list(words - self.number.keys())
        if self.used + len(missing) > self.kept:
            stay = [w for w in words if w in self.number]
            self.logs = self.logs[[self.number[w] for w in stay]]
            self.number, self.used = {w: i for i, w in enumerate(stay)}, len(stay)
        room = self.used + len(missing)
        if room > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(room, min(2 * room, self.kept)) - len(self.logs), self.logs.shape[1]))])
        self.logs[self.used : room] = self.model.words(missing)
        self.number.update(zip(missing, range(self.used, room), strict=True))
        self.long = [w for w in missing if len(w) > self.longest]
        self.used = room


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = h * _BASE + np.uint64(c) + np.uint64(1)
    return (h * _BASE)[0]


def fit(labelled: DataFrame, model: str, smoothing: float = 0.1) -> LanguageModel:
    """A model of the languages of ``labelled(lang, text)``. To the driver come at most languages x pieces sums."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    rows = piece_counts(labelled, model).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(pieces), len(langs)))
    prior = np.zeros(len(langs))
    number = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    piece, n = rows["piece"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    prior[number[piece < 0]] = n[piece < 0]
    counts[piece[piece >= 0], number[piece >= 0]] = n[piece >= 0]
    probs = (counts + smoothing) / (counts.sum(0) + smoothing * len(pieces)) if langs else counts
    probs = np.vstack([probs, probs.min(axis=0, initial=1) / 100, np.zeros(len(langs))])
    return LanguageModel(langs, np.log(prior / prior.sum()) if langs else prior, probs, pieces)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` for every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = [] if "text" in keep else [F.col("text")]
    text_at = len(keep) if more else keep.index("text")

    def run(batches):
        m = sent.value
        rows = _Rows(m)
        for b in _slices(batches, text_at):
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(text_at).to_pylist()]
            split = [t.lower().split() for t in texts]
            preds, scores = [UNKNOWN] * len(split), np.zeros(len(split))
            needed = set().union(*split)
            if needed and m.langs:
                rows.meet(needed)
                number, logs = rows.number.__getitem__, rows.logs
                for i, words in enumerate(split):
                    if words:
                        own = m.prior + logs[np.fromiter(map(number, words), np.int64, len(words))].sum(0)
                        best = int(np.argmax(own))
                        preds[i], scores[i] = m.langs[best], 1 / np.exp(own - own[best]).sum()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(preds, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, *more).mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

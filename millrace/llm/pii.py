"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text as it stands. Then two transducers write a normalised text and, for each of its
characters, the source characters it stands for: the first maps homoglyphs (compatibility forms, look-alike
letters, other scripts' digits, dashes and spaces between digits) and deletes invisible characters; the second turns spelled digits into digits and
at/dot disguises into ``@`` and ``.``. Identifiers of the normalised text are mapped back to source offsets and added
unless they lie within a base span of their own kind; one that reaches beyond a base span, such as what a disguise left of an
address, is added beside it. A text that neither transducer would change is its own normal form and is not rewritten.

Spelled digits count in runs of three or more; a bare `` at `` needs a spelled dot in the name after it, bracketed
ones stand for themselves, so ordinary prose stays as it is.

Every pattern is read in time linear in the text, whatever it holds.

Defined results: a null or empty text has no spans; null ids and repeated rows are rows as others; other columns are
ignored; an empty table gives an empty one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.rows import documents

#: The kinds, in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")

#: Spelled digits in English, German, French and Spanish, from 0 to 9.
SPELLED = """
zero one two three four five six seven eight nine
null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq six sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve
"""
#: Cyrillic and Greek letters that look like the Latin one at the same place.
LOOK_ALIKES = ("АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικυ", "ABESIJKMHOPCTXaesijopcyxdqwhABEZHIKMNOPTYXoavpiku")
#: Dashes other than the hyphen-minus: hyphen, non-breaking hyphen, figure dash, en dash, minus. Spaces are all that Unicode calls so.
DASHES = "\u2010\u2011\u2012\u2013\u2212"
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ips(text: str) -> list[tuple[int, int, int]]:
    """Four parts at a time of each longest chain of numbers and dots: a match that begins within a number begins at its start too."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in order: leftmost, non-overlapping for each kind."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:
        # a run before @ that fails at its start fails at each later one too: the rest of the match is the same
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            past = m.end()
            out.append((start, 0, past))
        at = text.find("@", max(at + 1, past))
    if _DIGIT.search(text):
        if "." in text:
            out += _ips(text)
        for m in _CARD.finditer(text):
            digits = _NO_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def _characters() -> dict[str, str]:
    """What each single character is written as: its ASCII compatibility form, its digit, its look-alike, or nothing."""
    table = dict(zip(*LOOK_ALIKES, strict=True)) | dict.fromkeys(INVISIBLE, "")
    table |= dict.fromkeys(DASHES, "-")
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x20000)):
        c = chr(code)
        to = str(unicodedata.decimal(c)) if c.isdecimal() else " " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFKC", c)
        if len(to) == 1 and " " <= to <= "~":
            table.setdefault(c, to)
    return table | {"。": "."}


_CHARS = _characters()
_GAPS = "".join(sorted(c for c, to in _CHARS.items() if to == " " or c in DASHES))
# spaces and dashes count between digits only: in prose an en dash may follow an address
_ODD = re.compile("[" + re.escape("".join(sorted(_CHARS.keys() - set(_GAPS)))) + rf"]|(?<=[\d)])[{re.escape(_GAPS)}](?=[\d(])")
_DIGITS = {w: str(i) for line in SPELLED.split("\n") for i, w in enumerate(line.split())}
_ONE = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_GAP = r"(?:[\x20,]{1,2}|-)"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOT = "dot|punkt|point|punto"
_SIGNS = re.compile(
    rf"(?P<at>{_OPEN}(?:at|arroba){_CLOSE}|(?<=[a-z0-9])\s{{1,3}}(?:at|arroba)\s{{1,3}}(?=[a-z0-9-]{{1,63}}(?:\s{{1,3}}|{_OPEN})(?:{_DOT})\b))"
    rf"|(?P<dot>{_OPEN}(?:{_DOT}){_CLOSE}|(?<=[a-z0-9])\s{{1,3}}(?:{_DOT})\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<run>(?:\bplus\b{_GAP})?\b(?:{_ONE})\b(?:(?:{_GAP}|\s(?:{_DOT})\s)(?:{_ONE})\b){{2,}})"
)
_IN_RUN = re.compile(rf"\b(?:plus|{_ONE}|{_DOT})\b")
_WORDS, _DOTS = tuple(_DIGITS), frozenset(_DOT.split("|"))
_BRACKETS = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|arroba|{_DOT})\s{{0,3}}[\])}}>]")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def _may_change(low: str) -> bool:
    """False only if the second transducer surely leaves the text. A run of three has a middle digit between blanks."""
    words = low.replace("-", " ").replace(",", " ").split()
    if not _DOTS.isdisjoint(words) or _BRACKETS.search(low):
        return True
    spelled = [i for i, w in enumerate(words) if w in _DIGITS]
    return any(0 < i < len(words) - 1 and words[i - 1].endswith(_WORDS) and words[i + 1].startswith(_WORDS) for i in spelled)


def normalise(text: str) -> tuple[str, list[int], list[int]] | None:
    """The normalised text and, for each of its characters, where its source begins and ends; None if nothing changes."""
    out: list[str] = []
    begins: list[int] = []
    ends: list[int] = []

    def copy(a: int, z: int) -> None:
        out.append(text[a:z])
        begins.extend(range(a, z))
        ends.extend(range(a + 1, z + 1))

    changed, at = False, 0
    if not text.isascii() and not _CHARS.keys().isdisjoint(set(text)):
        for m in _ODD.finditer(text):
            copy(at, m.start())
            to = _CHARS[m[0]]
            out.append(to)
            begins.extend([m.start()] * len(to))
            ends.extend([m.end()] * len(to))
            at, changed = m.end(), True
    first = text
    if changed:
        copy(at, len(text))
        first = "".join(out)
    low = _lower(first)
    if not _may_change(low):
        return (first, begins, ends) if changed else None
    src_b, src_e = (begins, ends) if changed else (range(len(text)), range(1, len(text) + 1))
    out, begins, ends, at, again = [], [], [], 0, False

    def piece(a: int, z: int, to: str | None = None) -> None:
        """Characters a to z of the first form, as they are or all together as ``to``."""
        out.append(first[a:z] if to is None else to)
        if to is None:
            begins.extend(src_b[a:z])
            ends.extend(src_e[a:z])
        elif a < z:
            begins.extend([src_b[a]] * len(to))
            ends.extend([src_e[z - 1]] * len(to))

    for m in _SIGNS.finditer(low):
        piece(at, m.start())
        at, again = m.end(), True
        if m.lastgroup == "run":
            for w in _IN_RUN.finditer(low, m.start(), m.end()):
                piece(w.start(), w.end(), "+" if w[0] == "plus" else _DIGITS.get(w[0], "."))
        else:
            piece(m.start(), m.end(), "@" if m.lastgroup == "at" else ".")
    if not again:
        return (first, list(src_b), list(src_e)) if changed else None
    piece(at, len(first))
    return "".join(out), begins, ends


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, kind number, end, is base)`` in order."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    normal = normalise(text)
    if normal is not None:
        form, begins, ends = normal
        # spans of a kind do not overlap, so of the base ones only the last that starts no later can hold another
        starts, stops = [[s for s, k, _ in base if k == n] for n in range(len(KINDS))], [[e for _, k, e in base if k == n] for n in range(len(KINDS))]
        for s, kind, e in base_spans(form):
            a, z = begins[s], max(ends[s:e])
            i = bisect_right(starts[kind], a) - 1
            if i < 0 or stops[kind][i] < z:
                found.append((a, kind, z, False))
    return sorted(found)


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans`` for every row of ``docs``."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in spans(t or "")] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "spans"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, spans {SPAN}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"), added)

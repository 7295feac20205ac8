"""Functions over Arrow columns that hold a part of a batch at a time.

A batch has up to 10,000 rows, however long they are: made into Python objects at once, with what is made of them, long texts take
hundreds of MB in each worker. Parts are bounded by bytes; only a row that is larger than that by itself makes a larger one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes of a part, in Arrow's form.
PART_BYTES = 512 << 10
Rows = TypeVar("Rows", pa.Array, pa.RecordBatch)


def parts(rows: Rows, most: int = PART_BYTES) -> Iterator[Rows]:
    """``rows`` in order, halved until no part but a single row has more than ``most`` bytes."""
    stack = [rows]
    while stack:
        a = stack.pop()
        if len(a) < 2 or a.nbytes <= most:
            yield a
        else:
            half = len(a) // 2
            stack += [a.slice(half), a.slice(0, half)]


def in_parts(kind: str, made: Callable[[pa.Array], pa.Array]) -> Callable:
    """A function of a column, of Spark's type ``kind``: ``made`` of each part of its values."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield from map(made, parts(b))

    return run

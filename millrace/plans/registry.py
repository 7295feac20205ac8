"""Operators and their declared parameters.

An operator is a plain function; how it is run follows from its ``kind``:

=========  ==============================================  =====================================
kind       first arguments                                 returns
=========  ==============================================  =====================================
source     ``spark``                                       DataFrame
sink       ``df``                                          nothing; the input passes through
table      ``df``                                          DataFrame
map        ``df``, ``col`` (the field)                     Column, kept as ``output_field``
filter     ``df``, ``col`` (the field)                     boolean Column, used by ``mode``
sql        ``spark``, ``inputs`` (all frames by name)      DataFrame
=========  ==============================================  =====================================

Its other arguments, with their annotations and defaults, are the operator's parameters; unknown ones are refused.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, create_model, model_validator

Mode = Literal["tag", "filter", "tag_and_filter"]
LEADING = {"source": 1, "sink": 1, "table": 1, "map": 2, "filter": 2, "sql": 2}


class Common(BaseModel):
    """What every operator takes. ``select`` and ``drop`` exclude each other; ``cache`` is off unless asked for."""

    model_config = ConfigDict(extra="forbid", arbitrary_types_allowed=True)

    op_name: str
    input_df: str | None = None
    output_df: str | None = None
    partitions: int | None = None
    select: list[str] | None = None
    renames: dict[str, str] | None = None
    drop: list[str] | None = None
    limit: int = 0
    cache: Literal["disk", "memory", "memory_disk"] | None = None
    temp_view_name: str | None = None
    count: bool = False
    show: bool | dict[str, Any] = False

    @model_validator(mode="after")
    def _exclusive(self):
        if self.select and self.drop:
            raise ValueError("select and drop exclude each other")
        return self


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    run: Callable
    params: type[BaseModel]
    own: tuple[str, ...]
    reverse: bool = False

    def spec(self, **config) -> BaseModel:
        return self.params(**{"op_name": self.name, **config})


BUILT_IN: dict[str, Operator] = {}


def make(name: str, kind: str, fn: Callable, tag_field: str = "tag", reverse: bool = False) -> Operator:
    """An Operator of ``fn``. ``reverse``: a filter keeps the rows whose tag is false."""
    if kind not in LEADING:
        raise ValueError(f"unknown operator kind {kind!r}")
    hints = typing.get_type_hints(fn)
    own = {p.name: (hints.get(p.name, Any), ... if p.default is p.empty else p.default) for p in list(inspect.signature(fn).parameters.values())[LEADING[kind] :]}
    more: dict[str, Any] = {}
    if kind in ("map", "filter"):
        more["field"] = (str, ...)
    if kind == "map":
        more["output_field"] = (str, ...)
    if kind == "filter":
        more |= {"mode": (Mode, "filter"), "tag_field": (str, tag_field)}
    return Operator(name, kind, fn, create_model(name, __base__=Common, **more, **own), tuple(own), reverse)


def operator(name: str, kind: str, **options) -> Callable:
    """Registers the decorated function under ``name``."""

    def add(fn: Callable) -> Callable:
        if name in BUILT_IN:
            raise ValueError(f"operator {name!r} is already registered")
        BUILT_IN[name] = make(name, kind, fn, **options)
        return fn

    return add

"""Pipelines of operators: declared, checked as a whole, then built as one lazy plan.

A node reads the frame named ``input_df`` and gives the one named ``output_df``. Nodes run in an order that
the names allow; frames live in a context of the run, never in a global.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pydantic import BaseModel, ValidationError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import BUILT_IN, Operator, make

log = logging.getLogger("millrace")
LEVELS = {"disk": StorageLevel.DISK_ONLY, "memory": StorageLevel.MEMORY_ONLY, "memory_disk": StorageLevel.MEMORY_AND_DISK}


def tagged(df: DataFrame, tag: str, condition, mode: str, reverse: bool = False) -> DataFrame:
    """``condition`` as a tag, a filter or both. Rows with a null condition do not pass a filter."""
    if mode == "tag":
        return df.withColumn(tag, condition)
    keep = ~F.col(tag) if reverse else F.col(tag)
    out = df.withColumn(tag, condition).filter(keep)
    return out.drop(tag) if mode == "filter" else out


def finish(df: DataFrame, spec: BaseModel) -> DataFrame:
    """The common parameters, in their fixed order."""
    if spec.select:
        df = df.select(*spec.select)
    for old, new in (spec.renames or {}).items():
        df = df.withColumnRenamed(old, new)
    if spec.drop:
        df = df.drop(*spec.drop)
    if spec.limit:
        df = df.limit(spec.limit)
    if spec.cache:
        df = df.persist(LEVELS[spec.cache])
    if spec.temp_view_name:
        df.createOrReplaceTempView(spec.temp_view_name)
    if spec.count:
        log.info("%s: %d rows", spec.output_df or spec.op_name, df.count())
    if spec.show:
        df.show(**(spec.show if isinstance(spec.show, dict) else {}))
    return df


def apply(op: Operator, spec: BaseModel, spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    own = {k: getattr(spec, k) for k in op.own}
    if op.kind == "source":
        return finish(op.run(spark, **own), spec)
    if op.kind == "sql":
        return finish(op.run(spark, frames, **own), spec)
    df = frames[spec.input_df]
    if spec.partitions:
        df = df.repartition(spec.partitions)
    if op.kind == "sink":
        op.run(df, **own)
    elif op.kind == "table":
        df = op.run(df, **own)
    else:
        if spec.field not in df.columns:
            raise ValueError(f"{op.name}: there is no column {spec.field!r} among {df.columns}")
        made = op.run(df, F.col(f"`{spec.field}`"), **own)
        df = df.withColumn(spec.output_field, made) if op.kind == "map" else tagged(df, spec.tag_field, made, spec.mode, op.reverse)
    return finish(df, spec)


def run_operator(name: str, df: DataFrame | None = None, spark: SparkSession | None = None, **params) -> DataFrame:
    """One built-in operator by itself."""
    op = BUILT_IN[name]
    frames = {} if df is None else {"df": df}
    return apply(op, op.spec(**({} if df is None else {"input_df": "df"}), **params), spark or df.sparkSession, frames)


@dataclass
class Node:
    name: str
    op: Operator
    spec: BaseModel


@dataclass
class Pipeline:
    """``config``: node name -> parameters, ``op_name`` among them. ``operators``: further ones by name, a function given as (kind, function)."""

    config: dict[str, dict[str, Any]]
    operators: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, path: str, operators: dict[str, Any] | None = None) -> Pipeline:
        with open(path, encoding="utf-8") as f:
            return cls(yaml.safe_load(f), operators or {})

    @classmethod
    def from_dict(cls, config: dict[str, dict[str, Any]], operators: dict[str, Any] | None = None) -> Pipeline:
        return cls(config, operators or {})

    @classmethod
    def from_list(cls, steps: Iterable[dict[str, Any]], operators: dict[str, Any] | None = None) -> Pipeline:
        return cls({f"{i}:{s.get('op_name')}": s for i, s in enumerate(steps)}, operators or {})

    def known(self) -> dict[str, Operator]:
        extra = {}
        for name, op in self.operators.items():
            if name in BUILT_IN:
                raise ValueError(f"operator {name!r} is already registered")
            extra[name] = op if isinstance(op, Operator) else make(name, *op)
        return BUILT_IN | extra

    def nodes(self) -> list[Node]:
        """The nodes, checked, in an order in which every frame exists before it is read."""
        known, found = self.known(), []
        for name, params in self.config.items():
            op = known.get(params.get("op_name"))
            if op is None:
                raise ValueError(f"{name}: unknown operator {params.get('op_name')!r}")
            try:
                spec = op.params(**params)
            except ValidationError as e:
                raise ValueError(f"{name} ({op.name}): {e}") from e
            if op.kind not in ("source", "sql") and not spec.input_df:
                raise ValueError(f"{name} ({op.name}): input_df is missing")
            if op.kind != "sink" and not spec.output_df:
                raise ValueError(f"{name} ({op.name}): output_df is missing")
            found.append(Node(name, op, spec))
        for what, names in (("output_df", [n.spec.output_df for n in found]), ("temp_view_name", [n.spec.temp_view_name for n in found])):
            twice = [k for k, v in Counter(x for x in names if x).items() if v > 1]
            if twice:
                raise ValueError(f"{what} {twice[0]!r} is given more than once")
        made = {n.spec.output_df for n in found}
        for n in found:
            if n.op.kind not in ("source", "sql") and n.spec.input_df not in made:
                raise ValueError(f"{n.name}: no node gives the frame {n.spec.input_df!r}")
        ordered, there, waiting = [], set(), found
        while waiting:
            # SQL may read the views of whatever stands before it, so it keeps its place
            ready = next((i for i, n in enumerate(waiting) if n.op.kind == "source" or n.op.kind != "sql" and n.spec.input_df in there or n.op.kind == "sql" and i == 0), None)
            if ready is None:
                raise ValueError("frames are read in a circle: " + ", ".join(n.name for n in waiting))
            n = waiting.pop(ready)
            ordered.append(n)
            there.add(n.spec.output_df)
        return ordered

    def run(self, spark: SparkSession) -> DataFrame:
        """The frame of the last node declared. A frame that two nodes or more read is kept on disk while the session lives."""
        nodes, frames = self.nodes(), {}
        readers = Counter(n.spec.input_df for n in nodes if n.spec.input_df)
        last = list(self.config)[-1]
        out = None
        for n in nodes:
            df = apply(n.op, n.spec, spark, frames)
            if readers[n.spec.output_df] > 1 and not n.spec.cache and not df.isStreaming and n.op.kind != "source":
                df = df.persist(StorageLevel.DISK_ONLY)
            if n.spec.output_df:
                frames[n.spec.output_df] = df
            if n.name == last:
                out = df
        return out

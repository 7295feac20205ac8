"""Intermediate tables that outlive executors.

``durable`` writes a DataFrame as Parquet under the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back: the lineage is cut, a lost executor costs
nothing that was written, and every executor sees the files. The shuffle files that led
to it go as soon as it is written; ``discard`` removes the table itself. Where the setting is
absent a local master gets a temporary folder, made once for the session, and any other is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a task gathers before it writes them; Spark's own 128 MB would be a good part of a small executor's heap.
ROW_GROUP = 16 << 20
#: What a broadcast side may hold, rows' own bytes.
BROADCAST_BYTES = 16 << 20

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _made[app], True)
    return _made[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's to clean then
        pass


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder until it is discarded or the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``durable`` made. Nothing that reads them may run afterwards."""
    for t in tables:
        _remove(t.sparkSession, t.durable_path)


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value has."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        size = 8 * F.greatest(F.size(col), F.lit(0))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(col)))
    else:
        return F.lit(8).cast("long")
    return 8 + F.coalesce(size, F.lit(0)).cast("long")


def fits(df: DataFrame, max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of ``max_bytes`` bytes together.

    ``df`` should be a durable or otherwise cheap table: it is counted, and the count stops at the bound.
    """
    size = sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(0).cast("long"))
    n, held = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return n <= max_rows and (held or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it ``fits``, else as it is."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df

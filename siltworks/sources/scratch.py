"""Shared scratch folder: cuts lineage with written tables that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

# A stored table up to this many (uncompressed) bytes may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="siltworks-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses. Inside a ``scratch_scope`` it is deleted at its end."""
    path = f"{shared_folder(spark)}/siltworks/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what was stored inside, also by an inner step, when the block ends.

    Results that are read after the block must have been written elsewhere or collected: frames are lazy.
    """
    _scopes.append([])
    try:
        yield
    finally:
        discard(spark, _scopes.pop())


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete stored tables that no frame still to be run reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete the files of their shuffles when they end, not when the driver happens to collect its garbage.

    For steps that are written. Frames that a caller may run more than once are made outside.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Stored:
    """A written table together with the row and byte counts seen while it was written."""

    df: DataFrame
    rows: int
    bytes: int
    widths: dict[str, int] = field(default_factory=dict)
    paths: tuple[str, ...] = ()

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def select(self, *columns: str) -> Stored:
        """Some of the columns, with the bytes that were measured for them."""
        widths = {c: self.widths[c] for c in columns}
        return Stored(self.df.select(*columns), self.rows, sum(widths.values()), widths, self.paths)

    def renamed(self, names: dict[str, str]) -> Stored:
        """The same rows under other column names."""
        widths = {names.get(c, c): w for c, w in self.widths.items()}
        return Stored(self.df.withColumnsRenamed(names), self.rows, self.bytes, widths, self.paths)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes one value takes in memory: measured for text, fixed for other scalars, the sum of the parts for the rest."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            each = F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + _width(x, inner))
        else:
            each = F.size(value) * 16
        return F.coalesce(F.when(value.isNotNull(), each), F.lit(0)) + F.lit(16)
    return F.lit(16)


def cut(df: DataFrame, label: str) -> Stored:
    """Write ``df`` once to the shared folder and go on from the written table."""
    seen = Observation(f"cut-{uuid.uuid4().hex}")
    path = scratch_path(df.sparkSession, label)
    # columns of fixed width follow from the row count
    measured = {
        f"w{k}": _width(F.col(f"`{f.name}`"), f.dataType)
        for k, f in enumerate(df.schema.fields)
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType))
    }
    sums = [F.coalesce(F.sum(w.cast("bigint")), F.lit(0)).alias(k) for k, w in measured.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.parquet(path)
    counts = seen.get
    widths = {f.name: counts.get(f"w{k}", 16 * counts["rows"]) for k, f in enumerate(df.schema.fields)}
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), counts["rows"], sum(widths.values()), widths, (path,))

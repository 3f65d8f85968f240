"""Writers; every one reports what it wrote without a second pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

STATUS = "source string, target string, rows bigint, error string"


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path under any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def write_new(df: DataFrame, path: str) -> int:
    """Write a new Parquet directory; the row count is observed while writing. What a failed write left is removed."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    except Exception:
        remove(df.sparkSession, path)
        raise
    return seen.get["rows"]


def write_layer(df: DataFrame, path: str) -> int:
    """Replace a Parquet directory; returns the number of rows.

    The rows are written beside the old directory and take its place only when all of them are there, so that a failed
    write loses nothing and a layer can be made from itself. Readers that must not see the moment of the change go
    through a catalog table (``catalog.publish``).
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    # names that Spark's file sources do not list
    folder, name = path.rpartition("/")[::2]
    new, old = (f"{folder}/_{name}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows = write_new(df, new)
    (files, at), was = _files(spark, path), _files(spark, old)[1]
    there = files.exists(at)
    if there and not files.rename(at, was):
        remove(spark, new)
        raise OSError(f"cannot set {path} aside")
    if not files.rename(_files(spark, new)[1], at):
        if there:
            files.rename(was, at)
        raise OSError(f"cannot move the new rows to {path}")
    if there:
        remove(spark, old)
    return rows


NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # the file of texts without a path


def _write_texts(rows: Iterable, files, top: str) -> None:
    """Write rows (at, value), sorted by ``at``, to one file for each ``at`` below ``top``."""
    local = files.type_name == "local"
    for at, some in groupby(rows, key=lambda r: r["at"]):
        path = f"{top}/{at}"
        files.create_dir(path.rpartition("/")[0], recursive=True)
        if local:  # a checksum that Hadoop left for an older file
            sums = "/.".join(path.rsplit("/", 1)) + ".crc"
            if files.get_file_info(sums).is_file:
                files.delete_file(sums)
        with files.open_output_stream(path) as out:
            for row in some:
                out.write((row["value"] or "").encode() + b"\n")


def write_corpus(corpus: DataFrame, path_column: str, root: str) -> None:
    """Write every text of ``corpus(<path_column>, source)`` to a file of its own, at its path below ``root``.

    Tasks write the files where they belong. Texts of one path share its file. A text ends with one line break in its file.
    Where only Hadoop knows the scheme of ``root``, tasks write the texts and the driver renames the files.
    """
    root = root.rstrip("/")
    at = F.coalesce(F.nullif(F.regexp_replace(path_column, "^/+", ""), F.lit("")), F.lit(NO_NAME))
    named = corpus.select(at.alias("at"), F.regexp_replace("source", r"\n\z", "").alias("value"))
    # texts of one path meet in one task
    named = named.repartition("at").sortWithinPartitions("at")
    try:
        files, top = FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        _write_renamed(named, root)
        return
    named.foreachPartition(partial(_write_texts, files=files, top=top))


def _write_renamed(named: DataFrame, root: str) -> None:
    spark = named.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    named.write.partitionBy("at").text(staged)
    files, top = _files(spark, staged)
    for folder in files.listStatus(top):
        name = folder.getPath().getName()
        if not name.startswith("at="):
            continue
        target = _files(spark, f"{root}/{unquote(name[3:])}")[1]
        files.mkdirs(target.getParent())
        for written in files.listStatus(folder.getPath()):
            files.rename(written.getPath(), target)
    remove(spark, staged)


def write_report(df: DataFrame, path: str) -> None:
    """Write a small result (scores, totals) as JSON lines."""
    df.write.mode("overwrite").json(path)


def attempt(action: Callable[[], int]) -> tuple[int | None, str | None]:
    """Row count or whole error text of one step; a failed step does not stop the others."""
    try:
        return action(), None
    except Exception as e:
        return None, str(e)


def ingest(
    spark: SparkSession,
    tables: list[tuple],
    reader: Callable[..., DataFrame],
    out: str,
    at_once: int = 4,
) -> DataFrame:
    """Copy source tables to ``out/<target>``; one status row per table.

    ``tables`` holds (source, target) or (source, target, split); a split (``readers.Split``) is handed to the reader.

    Tables are independent Spark jobs, ``at_once`` of them submitted together so that the tail of
    one table does not leave the cluster idle. Error texts are whole; ``shortened`` cuts them for display.
    """

    def copy(table: tuple):
        source, target, *split = table
        rows, error = attempt(lambda: write_layer(reader(spark, source, *split), f"{out.rstrip('/')}/{target}"))
        return source, target, rows, error

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(copy, tables)), STATUS)


def shortened(status: DataFrame, characters: int = 150) -> DataFrame:
    """A status table for display, with error texts cut to a number of characters."""
    return status.withColumn("error", F.left("error", F.lit(characters)))


def total_rows(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))

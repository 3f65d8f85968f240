"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltworks.sources.scratch import cut

BATCH = 1_000  # rows of texts that are sent to Python at a time
FOLDS = 4
HELD_OUT = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as bigint and ``text`` with NULL as empty; other columns are left behind, so they cannot clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, lost executors cost no rerun."""
    return cut(df, label).df


def small_batches(spark: SparkSession) -> None:
    """From now on, tasks of this session send at most ``BATCH`` rows to Python at a time (a smaller number that is set holds).

    Whole texts are wide: Spark's 10,000 rows take tens of MB four times a task, in and out, in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:  # 0 or less: no limit
        spark.conf.set(key, BATCH)


def held_out(doc_id: Column) -> Column:
    """Is the document in the fold that no model learns from? A NULL id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int, part: int | None = None) -> DataFrame:
    """About ``most`` of the labelled ``rows`` (all, if there are fewer), picked by a hash of ``key``; with ``part`` no fewer than one
    in so many."""
    there = rows.count()
    most = max(most, there // part) if part else most
    if there <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * (most / there)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda would compute it anew in every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows, so that few texts are decoded at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)

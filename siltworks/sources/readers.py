"""Readers for source tables, layers, catalog tables and text corpora."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions.text import last_part


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    **properties: str,
) -> dict[str, str]:
    """Options of a JDBC read; a partition column with bounds splits it over the executors."""
    options = {"url": url, "dbtable": table, **properties}
    split = (partition_column, bounds, partitions)
    if any(x is not None for x in split):
        if any(x is None for x in split):
            raise ValueError("a split read needs partition_column, bounds and partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


@dataclass(frozen=True)
class Split:
    """How a source table is read in parts: by ranges of ``column`` between ``cuts``, in order."""

    column: str
    cuts: tuple[int | str, ...] = ()

    def predicates(self) -> list[str]:
        """One condition per part; every row meets exactly one, those without a value the first."""

        def text(value: int | str) -> str:
            return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

        c, cuts = self.column, [text(v) for v in self.cuts]
        if not cuts:
            return ["1 = 1"]
        middle = [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
        return [f"{c} < {cuts[0]} OR {c} IS NULL", *middle, f"{c} >= {cuts[-1]}"]


def plan_split(probe: Callable[[str], Sequence], table: str, column: str, rows_per_part: int = 1_000_000, buckets: int = 1000) -> Split:
    """Cut points of ``column`` that give parts of about ``rows_per_part`` rows.

    ``probe`` runs a query at the source and returns its rows; it is asked for the range of an integer column, then for a
    histogram of ``buckets`` equal ranges, so that gaps and dense stretches get parts of their own. At most ``buckets``
    rows come back, at any size of the table. A single value is never parted.
    """
    ((low, high, rows),) = probe(f"SELECT MIN({column}), MAX({column}), COUNT(*) FROM {table}")
    if low is None or rows <= rows_per_part:
        return Split(column)
    width = max(1, -(-(high - low + 1) // buckets))
    bucket = f"({column} - ({low}) - ({column} - ({low})) % {width}) / {width}"  # whole-number division in every dialect
    found = probe(f"SELECT {bucket} AS b, COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {bucket}")
    cuts, held = [], 0
    for b, n in sorted((int(b), n) for b, n in found):
        if held and held + n > rows_per_part:
            cuts.append(low + b * width)
            held = 0
        held += n
    return Split(column, tuple(cuts))


def read_jdbc(spark: SparkSession, url: str, table: str, split: Split | None = None, **options) -> DataFrame:
    """One source table over JDBC, in the parts of ``split``; user, password and driver come in as options."""
    if split is None:
        return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
    return spark.read.jdbc(url, table, predicates=split.predicates(), properties=options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _corpus(spark: SparkSession, root: str, glob: str, path_column: str) -> DataFrame:
    """Whole files with their paths as they are named on disk (the file source hands them out URI-encoded)."""
    text = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    # a plus sign is itself in a path, but a blank to url_decode
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(path.alias(path_column), F.col("value").alias("source"))


def read_scripts(spark: SparkSession, root: str) -> DataFrame:
    """``(script_path, source)`` of every ``*.py`` below ``root``, one row per file.

    Files starting with ``__`` and the folders ``__pycache__`` and ``lineage_engine`` are left out.
    Spark's file source also hides names that start with ``_`` or ``.``; hand in a corpus table to
    scan those.
    """
    path = F.col("script_path")
    inside = F.substring_index(path, root.rstrip("/"), -1)
    skipped = F.rlike(inside, F.lit("/(__pycache__|lineage_engine)/"))
    return _corpus(spark, root, "*.py", "script_path").filter(~last_part(path).startswith("__") & ~skipped)


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """``(dag_path, source)`` of every ``dag_*.py`` below ``root``."""
    return _corpus(spark, root, "dag_*.py", "dag_path")

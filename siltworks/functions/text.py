"""String rules for paths, names and layers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Marks of a storage address.
STORAGE_MARKS = ["s3a://", "hdfs://", "hive://", "file://", "gs://", "abfss://", "wasbs://", "dbfs://", "jdbc:", "delta://"]

# Display-label replacements of a job id, applied in this order.
JOB_LABELS = [
    ("ingesta_adventureworks", "Ingesta AW"),
    ("aw_bronze_to_silver", "B→S: AW"),
    ("aw_silver_to_gold", "S→G: AW"),
    ("bronze_to_silver_", "B→S: "),
    ("silver_to_gold_", "S→G: "),
]


def no_slash(c: Column) -> Column:
    """Drop trailing slashes."""
    return F.rtrim(c, F.lit("/"))


def bare(c: Column) -> Column:
    """Outer white space and trailing slashes removed."""
    return no_slash(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")))


def clean_path(c: Column) -> Column:
    """Bare path with ``file:/x`` and ``file:///x`` made equal."""
    path = bare(c)
    return F.when(F.startswith(path, F.lit("file:")), F.regexp_replace(path, "^file:/+", "file:/")).otherwise(path)


def normal_id(c: Column) -> Column:
    """Form in which two ids are compared when lineage is scored."""
    return F.lower(bare(c))


def last_part(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def short_name(node_id: Column) -> Column:
    """Last path part, then its last dotted part."""
    return F.substring_index(last_part(node_id), ".", -1)


def display_id(node_id: Column) -> Column:
    return F.regexp_replace(node_id, "[^a-zA-Z0-9_-]", "_")


def has_any(c: Column, marks: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(c, F.lit(m)) for m in marks])


def storage_address(c: Column) -> Column:
    return has_any(c, STORAGE_MARKS)


def layer_of_path(path: Column) -> Column:
    """Layer of a dataset: bronze beats the others, gold beats silver; case does not matter."""
    p = F.lower(path)
    return (
        F.when(F.contains(p, F.lit("bronze")), "bronze")
        .when(F.contains(p, F.lit("gold")), "gold")
        .when(F.contains(p, F.lit("silver")), "silver")
        .otherwise("unknown")
    )


def stage_of_job(path: Column) -> Column:
    """Stage named in the path of a job definition; case matters."""
    return (
        F.when(F.contains(path, F.lit("bronze_to_silver")), "bronze_to_silver")
        .when(F.contains(path, F.lit("silver_to_gold")), "silver_to_gold")
        .otherwise("unknown")
    )


def stage_of_script(path: Column) -> Column:
    """Stage named in the path of a script: the first that fits; case matters."""
    return (
        F.when(F.contains(path, F.lit("bronze_to_silver")), "bronze_to_silver")
        .when(F.contains(path, F.lit("silver_to_gold")), "silver_to_gold")
        .when(F.contains(path, F.lit("ingesta")), "ingesta")
        .when(F.contains(path, F.lit("hive_register")), "catalog")
        .otherwise("unknown")
    )


def first_swap(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of ``old``; the anchor keeps later ones."""
    return F.regexp_replace(text, f"(?s)^(.*?){re.escape(old)}", f"$1{new}")


def job_label(dag_id: Column) -> Column:
    """Readable job name; every replacement touches the first occurrence only."""
    for old, new in JOB_LABELS:
        dag_id = first_swap(dag_id, old, new)
    return dag_id


def full_name(first: Column, last: Column) -> Column:
    """Both parts with a blank between, trimmed; empty text when neither is known."""
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))

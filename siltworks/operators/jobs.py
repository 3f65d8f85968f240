"""Workflow definitions: a corpus table in, one record per definition out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions.syntax import JOB_DDL, parse_jobs
from siltworks.functions.text import last_part, stage_of_job

# Text patterns of job definitions.
DAG_ID = r"""(?Ud)dag_id=["']([^"']+)["']"""
SCHEDULE = r"""(?Ud)schedule_interval=["']([^"']+)["']"""
TAGS = r"(?Ud)tags=\[([^\]]+)\]"
QUOTED = r"""(?Ud)["']([^"']+)["']"""
TASK_ID = r"""(?Ud)task_id=["']([^"']+)["']"""
APPLICATION = r"""(?Ud)application=["']([^"']+)["']"""
BASH_TEXT = r"""(?Ud)bash_command=["']([^"']+)["']"""
BASH_GROUP = r"(?Uds)bash_command=\(([^)]+)\)"
SCRIPT_PATHS = [r"""(?Ud)/opt/airflow/scripts/[^\s"']+\.py""", r"""(?Ud)scripts/[^\s"']+\.py"""]

TASK = "struct<task_id:string,operator:string,bash_command:string,application:string>"


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _last(calls: Column, pattern: str) -> Column:
    """Match in the last call that has one."""
    found = F.filter(F.transform(calls, lambda c: _match(c, pattern)), lambda m: m.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def _is_dag(call: Column) -> Column:
    return F.contains(call, F.lit("DAG(")) & F.contains(call, F.lit("dag_id"))


def _task(call: Column) -> Column:
    bash = F.contains(call, F.lit("BashOperator("))
    command = F.coalesce(_match(call, BASH_TEXT), F.trim(_match(call, BASH_GROUP)), F.lit(""))
    submit = F.contains(call, F.lit("SparkSubmitOperator("))
    return F.struct(
        _match(call, TASK_ID).alias("task_id"),
        F.when(bash, "BashOperator").when(submit, "SparkSubmitOperator").alias("operator"),
        F.when(bash, command).alias("bash_command"),
        F.when(~bash & submit, _match(call, APPLICATION)).alias("application"),
    ).cast(TASK)


def job_defs(corpus: DataFrame) -> DataFrame:
    """Id, schedule, tags, tasks, dependencies and scripts of ``corpus(dag_path, source)``, parsed where its splits lie."""
    mentioned = F.concat(*[F.regexp_extract_all("source", F.lit(p), F.lit(0)) for p in SCRIPT_PATHS])
    parsed = (
        corpus.select("dag_path", "source", F.array_sort(F.array_distinct(mentioned)).alias("scripts"))
        .mapInArrow(parse_jobs, JOB_DDL)
    )
    dags = F.filter("calls", _is_dag)
    listed = F.regexp_extract_all(_last(dags, TAGS), F.lit(QUOTED), F.lit(1))
    tasks_of = F.transform(F.filter("calls", lambda c: ~_is_dag(c)), _task)
    known = F.filter(tasks_of, lambda t: t["task_id"].isNotNull() & t["operator"].isNotNull())
    return parsed.select(
        _last(dags, DAG_ID).alias("dag_id"),
        "dag_path",
        last_part(F.col("dag_path")).alias("dag_file"),
        _last(dags, SCHEDULE).alias("schedule"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("tags"),
        known.alias("tasks"),
        F.col("shifts").alias("dependencies"),
        "scripts",
        stage_of_job(F.col("dag_path")).alias("layer"),
        "error",
    )

"""The lineage graph: a node table and an edge table built from the three scans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from siltworks.functions.text import clean_path, last_part, layer_of_path, no_slash
from siltworks.operators.skew import skew_join
from siltworks.sources.scratch import Stored, cut

NODE_COLUMNS = [
    "node_id", "node_type", "layer", "database", "table_name", "full_name", "location",
    "format", "row_count", "column_count", "columns_json", "scanned_at",
]
EDGE_COLUMNS = ["source_id", "target_id", "script", "dag_id", "layer", "transformations", "scanned_at"]


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def catalog_nodes(catalog: DataFrame) -> DataFrame:
    """One node per catalog table."""
    columns = F.coalesce("columns", F.array().cast("array<struct<name:string,type:string>>"))
    return catalog.select(
        F.concat(F.lit("hive://"), "full_name").alias("node_id"),
        F.lit("hive_table").alias("node_type"),
        "layer",
        "database",
        F.col("table").alias("table_name"),
        "full_name",
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce(F.nullif("format", F.lit("")), F.lit("parquet")).alias("format"),
        F.coalesce(F.col("row_count").cast("bigint"), F.lit(0)).alias("row_count"),
        F.size(columns).cast("bigint").alias("column_count"),
        F.to_json(columns).alias("columns_json"),
        _now().alias("scanned_at"),
    )


def dataset_nodes(scripts: DataFrame) -> DataFrame:
    """One node per written address; the first write in path and source order describes it."""
    writes = scripts.filter(F.col("error").isNull()).select(
        "script_path", F.posexplode("writes").alias("at", "write")
    )
    path = F.col("write.path")
    first = (
        writes.filter(path != "")
        .groupBy(no_slash(path).alias("node_id"))
        .agg(F.min(F.struct("script_path", "at", path.alias("path"), F.col("write.format").alias("format"))).alias("w"))
    )
    return first.select(
        "node_id",
        F.lit("dataset").alias("node_type"),
        layer_of_path(F.col("w.path")).alias("layer"),
        F.lit("").alias("database"),
        last_part(F.col("w.path")).alias("table_name"),
        F.col("node_id").alias("full_name"),
        F.col("w.path").alias("location"),
        F.coalesce("w.format", F.lit("")).alias("format"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.lit(0).cast("bigint").alias("column_count"),
        F.lit("[]").alias("columns_json"),
        _now().alias("scanned_at"),
    )


def script_jobs(jobs: DataFrame) -> DataFrame:
    """Script file name to job id; the job last in path order wins."""
    return (
        jobs.select("dag_path", F.coalesce("dag_id", F.lit("")).alias("dag_id"), F.explode("scripts").alias("path"))
        .groupBy(last_part(F.col("path")).alias("script"))
        .agg(F.max_by("dag_id", "dag_path").alias("dag_id"))
    )


def flow_edges(scripts: DataFrame, jobs: DataFrame) -> DataFrame:
    """One edge per flow and source, with the job that runs the script.

    Empty ends and self loops are dropped. Script path and line stay in the rows until the join,
    so that copies of one script spread over all tasks. Starts a job.
    """
    flows = scripts.filter(F.col("error").isNull()).select(
        "script", "script_path", "layer", F.explode("flows").alias("flow")
    )
    ends = flows.select(
        F.explode("flow.sources").alias("source"),
        no_slash(F.col("flow.target")).alias("target_id"),
        "script",
        "script_path",
        F.col("flow.line").alias("line"),
        "layer",
        F.array_join("flow.transformations", ",").alias("transformations"),
    ).withColumn("source_id", no_slash(F.col("source")))
    source, target = F.col("source_id"), F.col("target_id")
    ends = ends.filter((source != "") & (target != "") & (source != target))
    joined = skew_join(ends, cut(script_jobs(jobs), "script-jobs"), "script", "left")
    return joined.select(
        "source_id",
        "target_id",
        "script",
        F.coalesce("dag_id", F.lit("")).alias("dag_id"),
        F.coalesce("layer", F.lit("")).alias("layer"),
        "transformations",
        _now().alias("scanned_at"),
    )


def table_places(nodes: DataFrame) -> DataFrame:
    """Location to catalog node; of several tables at one place the last by name wins."""
    return (
        nodes.filter((F.col("node_type") == "hive_table") & (F.col("location") != ""))
        .groupBy(clean_path(F.col("location")).alias("place"))
        .agg(F.max(F.struct("database", "table_name", "node_id")).alias("last"))
        .select("place", F.col("last.node_id").alias("home"))
    )


def _rehome(edges: DataFrame, places: Stored) -> DataFrame:
    """Edges with their ends moved to the catalog table at the same place.

    Few places are broadcast. For many, every distinct end is looked up once, and the edges, stored once, are joined
    with what was found.
    """
    columns = edges.columns
    if places.small:
        moved = edges
        for end in ("source_id", "target_id"):
            found = moved.withColumn("place", clean_path(F.col(end))).join(F.broadcast(places.df), "place", "left")
            moved = found.withColumn(end, F.coalesce("home", end)).drop("place", "home")
        return moved.select(columns)
    moved = edges = cut(edges, "edges").df
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("end")).distinct()
    met = skew_join(ends.withColumn("place", clean_path(F.col("end"))), places, "place")
    homes = cut(met.select("end", "home"), "edge-homes")
    for end in ("source_id", "target_id"):
        named = replace(homes, df=homes.df.select(F.col("end").alias(end), F.col("home").alias("_home")))
        moved = skew_join(moved, named, end, "left", left_keys=edges.select(end))
        moved = moved.withColumn(end, F.coalesce("_home", end)).drop("_home")
    return moved.select(columns)


def merge_datasets(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold datasets into the catalog table at the same location and move their edges along. Starts jobs."""
    places = cut(table_places(nodes), "table-places")
    is_dataset = F.col("node_type") == "dataset"
    candidates = nodes.withColumn("place", F.when(is_dataset, clean_path(F.col("node_id"))))
    kept = skew_join(candidates, places, "place", "left_anti").select(nodes.columns)
    return kept, _rehome(edges, places)


def build_graph(scripts: DataFrame, jobs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the lake.

    ``scripts`` and ``jobs`` are read more than once: hand in stored scans, not the parsing plan.
    """
    tables = catalog_nodes(catalog)
    datasets = dataset_nodes(scripts).join(tables.select("node_id"), "node_id", "left_anti")
    return merge_datasets(tables.unionByName(datasets), flow_edges(scripts, jobs))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that are in no node row, with the number of edges at each."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("source").alias("end"), F.col("source_id").alias("node_id")),
            F.struct(F.lit("target").alias("end"), F.col("target_id").alias("node_id")),
        )
    )
    counted = edges.select(ends.alias("e")).groupBy("e.end", "e.node_id").agg(F.count(F.lit(1)).alias("edges"))
    return counted.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", "end", "edges")


def run_summary(scripts: DataFrame, jobs: DataFrame, catalog: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: scripts, jobs, tables, nodes, edges."""
    inputs = {"scripts": scripts, "jobs": jobs, "tables": catalog, "nodes": nodes, "edges": edges}
    counted = None
    for name, df in inputs.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(
            *[(F.col("n") if k == name else F.lit(0).cast("bigint")).alias(k) for k in inputs]
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted.agg(*[F.sum(k).alias(k) for k in inputs])

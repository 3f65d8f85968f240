"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siltworks.operators import clean, conform, graph, lineage, marts, quality
from siltworks.operators.jobs import job_defs
from siltworks.operators.scan import scan_totals, script_flows
from siltworks.plans.pipeline import save_graph
from siltworks.samples.frames import job_corpus, job_records, loose_scripts, scan_records, script_corpus
from siltworks.samples.views import TABLES, load
from siltworks.sources import catalog as cat
from siltworks.sources.readers import read_jobs, read_parquet, read_scripts, read_table
from siltworks.sources.scratch import cut, scratch_path
from siltworks.sources.sinks import ingest, total_rows, write_corpus, write_layer, write_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
QUERIES_RAW: dict[str, Query] = {}  # with audit stamps
DATABASE = "given"


def plain(df: DataFrame) -> DataFrame:
    """Drop audit stamps and turn decimals into doubles, so that results compare by value."""
    kept = [f for f in df.schema.fields if f.name not in (clean.STAMP, marts.STAMP, "scanned_at")]
    return df.select(
        *[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in kept]
    )


def query(f: Query) -> Query:
    QUERIES_RAW[f.__name__] = f
    QUERIES[f.__name__] = lambda spark, sf: plain(f(spark, sf))
    return f


# ---- layers -----------------------------------------------------------------------------


@query
def silver_orders(spark, sf):
    return clean.silver_orders(load(spark, sf, "raw_order_header"))


@query
def silver_order_lines(spark, sf):
    return clean.silver_order_lines(load(spark, sf, "raw_order_detail"))


@query
def silver_customers(spark, sf):
    return clean.silver_customers(load(spark, sf, "raw_customer"), load(spark, sf, "raw_person"))


@query
def silver_territories(spark, sf):
    return clean.silver_territories(load(spark, sf, "raw_territory"))


@query
def silver_products(spark, sf):
    return clean.silver_products(*[load(spark, sf, f"raw_{x}") for x in ("product", "subcategory", "category")])


@query
def silver_addresses(spark, sf):
    return clean.silver_addresses(load(spark, sf, "raw_address"))


@query
def gold_sales_by_territory(spark, sf):
    return marts.gold_sales_by_territory(silver_orders(spark, sf), silver_territories(spark, sf))


@query
def gold_sales_by_category(spark, sf):
    return marts.gold_sales_by_category(silver_order_lines(spark, sf), silver_products(spark, sf))


@query
def gold_sales_by_period(spark, sf):
    return marts.gold_sales_by_period(silver_orders(spark, sf))


@query
def gold_product_ranking(spark, sf):
    return marts.gold_product_ranking(silver_order_lines(spark, sf), silver_products(spark, sf))


@query
def gold_top_products(spark, sf):
    return marts.gold_product_ranking(silver_order_lines(spark, sf), silver_products(spark, sf), n=25)


# ---- ingest and catalog -----------------------------------------------------------------


def _ingested(spark, sf) -> DataFrame:
    pairs = [(f"{sf}/{t}.parquet", t) for t in TABLES]
    return ingest(spark, pairs, read_parquet, scratch_path(spark, "bronze"))


@query
def ingest_status(spark, sf):
    return _ingested(spark, sf).select(F.col("target").alias("table_name"), "rows", F.col("error").isNull().alias("ok"))


@query
def ingest_total(spark, sf):
    return total_rows(_ingested(spark, sf))


def _catalog(spark, sf) -> DataFrame:
    cat.create_layer(spark, DATABASE, "given tables")
    for t in TABLES:
        cat.register_table(spark, DATABASE, t, f"{sf}/{t}.parquet", load(spark, sf, t).schema)
    others = tuple(d for d in cat.list_databases(spark, ()) if d != DATABASE)
    found = cat.scan_catalog(spark, exclude=others)
    return found.filter(F.col("table").isin(TABLES))


@query
def layer_registration(spark, sf):
    base = scratch_path(spark, "bronze")
    ingest(spark, [(f"{sf}/{t}.parquet", t) for t in TABLES], read_parquet, base)
    cat.create_layer(spark, "ingested", "copy of the given tables")
    status = cat.register_layer(spark, "ingested", TABLES, base)
    return status.select(F.col("table").alias("table_name"), "rows", F.col("error").isNull().alias("ok"))


@query
def catalog_columns(spark, sf):
    return (
        _catalog(spark, sf)
        .select(F.col("table").alias("table_name"), F.posexplode("columns").alias("pos", "c"))
        .select("table_name", "pos", F.col("c.name").alias("column_name"), F.col("c.type").alias("column_type"))
    )


@query
def catalog_row_counts(spark, sf):
    return _catalog(spark, sf).select(F.col("table").alias("table_name"), "row_count", "format")


@query
def catalog_node_details(spark, sf):
    nodes = graph.catalog_nodes(_catalog(spark, sf))
    return nodes.select("table_name", F.substring_index("location", "/", -1).alias("folder"), "columns_json")


@query
def catalog_table_read(spark, sf):
    cat.create_layer(spark, "read_back")
    cat.register_table(spark, "read_back", "part", f"{sf}/part.parquet", load(spark, sf, "part").schema)
    return read_table(spark, "read_back.part").select("p_partkey", "p_name")


@query
def catalog_lost_table(spark, sf):
    """One table is there, the other has lost its files: its row stays, with an error."""
    base = scratch_path(spark, "lost")
    cat.create_layer(spark, "lossy")
    for t in ("part", "supplier"):
        write_layer(load(spark, sf, t), f"{base}/{t}")
        cat.register_table(spark, "lossy", t, f"{base}/{t}", load(spark, sf, t).schema)
    # text lies where one table's files should be
    load(spark, sf, "supplier").select("s_name").write.mode("overwrite").text(f"{base}/supplier")
    others = tuple(d for d in cat.list_databases(spark, ()) if d != "lossy")
    found = cat.scan_catalog(spark, exclude=others)
    return found.select(F.col("table").alias("table_name"), "row_count", F.col("error").isNotNull().alias("failed"))


@query
def audit_stamps(spark, sf):
    """Rows and stamped rows of every conformed table and mart."""
    marts_of = {n: (QUERIES_RAW[f"gold_{n}"], marts.STAMP) for n in ("sales_by_territory", "sales_by_category", "sales_by_period", "product_ranking")}
    tables = {n: (QUERIES_RAW[f"silver_{n}"], clean.STAMP) for n in ("orders", "order_lines", "customers", "territories", "products", "addresses")}
    counts = [
        make(spark, sf).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count(stamp).alias("stamped"))
        for name, (make, stamp) in (tables | marts_of).items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def republished_layer(spark, sf):
    """A layer that was published twice, read through the catalog: the second version only."""
    base = scratch_path(spark, "published")
    cat.create_layer(spark, "published")
    spark.sql("DROP TABLE IF EXISTS published.part")
    parts = load(spark, sf, "part").select("p_partkey", "p_name")
    cat.publish(spark, "published", "part", parts, f"{base}/part")
    cat.publish(spark, "published", "part", read_table(spark, "published.part").withColumn("p_name", F.upper("p_name")), f"{base}/part")
    return read_table(spark, "published.part")


@query
def catalog_nodes(spark, sf):
    nodes = graph.catalog_nodes(_catalog(spark, sf))
    return nodes.select("node_id", "node_type", "layer", "table_name", "format", "row_count", "column_count")


# ---- graph build ------------------------------------------------------------------------


@query
def dataset_nodes(spark, sf):
    return graph.dataset_nodes(scan_records(spark, sf))


@query
def flow_edges(spark, sf):
    return graph.flow_edges(scan_records(spark, sf), job_records(spark, sf))


def _merged(spark, sf):
    return graph.merge_datasets(load(spark, sf, "merge_nodes"), load(spark, sf, "merge_edges"))


@query
def merged_nodes(spark, sf):
    return _merged(spark, sf)[0]


@query
def merged_edges(spark, sf):
    return _merged(spark, sf)[1]


def _saved_graph(spark, sf, table: str) -> DataFrame:
    """Write both lineage tables, register them, and read one of them back through the catalog."""
    save_graph(spark, *_lineage_columns(_nodes(spark, sf), _edges(spark, sf)), scratch_path(spark, "lineage"))
    return read_table(spark, f"lineage.{table}")


def _lineage_columns(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    stamp = {"scanned_at": F.lit("")}
    return nodes.withColumns(stamp).select(graph.NODE_COLUMNS), edges.withColumns(stamp).select(graph.EDGE_COLUMNS)


@query
def saved_nodes(spark, sf):
    return _saved_graph(spark, sf, "lineage_metadata").select("node_id", "node_type", "layer", "table_name", "location", "row_count")


@query
def saved_edges(spark, sf):
    return _saved_graph(spark, sf, "lineage_graph_edges").groupBy("script", "dag_id", "layer").agg(F.count(F.lit(1)).alias("edges"))


@query
def dangling_edges(spark, sf):
    return graph.dangling_edges(_nodes(spark, sf), _edges(spark, sf))


# ---- graph questions --------------------------------------------------------------------


def _nodes(spark, sf) -> DataFrame:
    return load(spark, sf, "graph_nodes").drop("k")


def _edges(spark, sf) -> DataFrame:
    return load(spark, sf, "graph_edges").drop("k").withColumn("scanned_at", F.lit(""))


@query
def graph_totals(spark, sf):
    return lineage.totals(_nodes(spark, sf), _edges(spark, sf))


@query
def graph_stats_nodes(spark, sf):
    return lineage.count_by_layer(_nodes(spark, sf))


@query
def graph_stats_edges(spark, sf):
    return lineage.count_by_layer(_edges(spark, sf))


@query
def node_search(spark, sf):
    return lineage.search(_nodes(spark, sf), "R_1")


@query
def nodes_by_layer(spark, sf):
    return lineage.list_nodes(_nodes(spark, sf), "silver")


@query
def edges_filtered(spark, sf):
    return lineage.list_edges(_edges(spark, sf), "bronze_to_silver", "dag_1")


@query
def node_degrees(spark, sf):
    nodes = _nodes(spark, sf)
    detail = lineage.node_detail(nodes, _edges(spark, sf), nodes.select("node_id"))
    return detail.select("node_id", "upstream_count", "downstream_count")


@query
def node_detail_columns(spark, sf):
    nodes = _nodes(spark, sf)
    detail = lineage.node_detail(nodes, _edges(spark, sf), nodes.select("node_id"))
    return detail.select("node_id", "location", "format", F.posexplode_outer("columns").alias("pos", "c")).select(
        "node_id", "location", "format", "pos", F.col("c.name").alias("name"), F.col("c.type").alias("type")
    )


@query
def subgraph_nodes(spark, sf):
    return lineage.subgraph(_nodes(spark, sf), _edges(spark, sf), "gold", "silver_to_gold")[0]


@query
def subgraph_edges(spark, sf):
    return lineage.subgraph(_nodes(spark, sf), _edges(spark, sf), "gold", "silver_to_gold")[1]


def _seeds(spark, sf, table: str, key: str, prefix: str) -> DataFrame:
    return load(spark, sf, table).select(F.concat(F.lit(prefix), key).alias("node_id"))


def _upstream(spark, sf):
    seeds = _seeds(spark, sf, "customer", "c_custkey", "hive://silver.customer_")
    return lineage.upstream(_nodes(spark, sf), _edges(spark, sf), seeds)


def _downstream(spark, sf, crossed=True):
    seeds = _seeds(spark, sf, "part", "p_partkey", "hive://bronze.part_")
    return lineage.downstream(_nodes(spark, sf), _edges(spark, sf), seeds, crossed=crossed)


@query
def upstream_nodes(spark, sf):
    return _upstream(spark, sf)[0].select("seed_id", "node_id", "hop", "layer", "row_count")


@query
def upstream_edges(spark, sf):
    return _upstream(spark, sf)[1]


@query
def downstream_nodes(spark, sf):
    return _downstream(spark, sf, crossed=False)[0].select("seed_id", "node_id", "hop", "layer", "row_count")


@query
def downstream_edges(spark, sf):
    return _downstream(spark, sf)[1]


# ---- conform ----------------------------------------------------------------------------


@query
def canonical_nodes(spark, sf):
    return conform.canonical_nodes(load(spark, sf, "show_nodes"))[0]


@query
def canonical_map(spark, sf):
    return conform.canonical_nodes(load(spark, sf, "show_nodes"))[1]


def _resolved(spark, sf) -> DataFrame:
    return conform.resolve_edges(load(spark, sf, "show_nodes"), load(spark, sf, "show_edges"))


@query
def resolved_edges(spark, sf):
    return _resolved(spark, sf)


@query
def typed_edges(spark, sf):
    return conform.typed_edges(_resolved(spark, sf))


# ---- quality ----------------------------------------------------------------------------


@query
def edge_quality(spark, sf):
    return quality.edge_quality(load(spark, sf, "generated"), load(spark, sf, "truth"))


@query
def edge_outcomes(spark, sf):
    return quality.edge_outcomes(load(spark, sf, "generated"), load(spark, sf, "truth"))


@query
def edge_quality_by_script(spark, sf):
    scores = quality.edge_quality_by_script(load(spark, sf, "generated"), load(spark, sf, "truth"))
    return scores.withColumn("mark", quality.mark(F.col("f1")))


@query
def transform_quality(spark, sf):
    return quality.transform_quality(load(spark, sf, "generated"), load(spark, sf, "truth_ops"))


@query
def node_quality(spark, sf):
    return quality.node_quality(load(spark, sf, "graph_nodes"), load(spark, sf, "truth_tables"))


@query
def overall_quality(spark, sf):
    return quality.overall_quality(*_scores(spark, sf))


def _scores(spark, sf) -> tuple[DataFrame, ...]:
    # the columns of the edges that the views over them read
    edges = load(spark, sf, "graph_edges").select("source_id", "target_id", "script", "transformations", "k")
    ready = {"graph_edges": cut(edges, "edges").df}
    gen, truth, ops = (load(spark, sf, v, ready) for v in ("generated", "truth", "truth_ops"))
    nodes = quality.node_quality(load(spark, sf, "graph_nodes"), load(spark, sf, "truth_tables"))
    return *quality.edge_scores(gen, truth), quality.transform_quality(gen, ops), nodes


@query
def quality_report(spark, sf):
    """The report as it is read back from its JSON file."""
    report = quality.quality_report(*_scores(spark, sf))
    path = scratch_path(spark, "report")
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


# ---- scans ------------------------------------------------------------------------------


def _scripts(spark, sf) -> DataFrame:
    return script_flows(script_corpus(spark, sf))


def _accesses(spark, sf, kind: str) -> DataFrame:
    rows = _scripts(spark, sf).select("script", F.explode(kind).alias("x"))
    return rows.select("script", "x.path", "x.format", "x.line")


@query
def script_reads(spark, sf):
    return _accesses(spark, sf, "reads")


@query
def script_writes(spark, sf):
    return _accesses(spark, sf, "writes")


@query
def script_flow_edges(spark, sf):
    flows = _scripts(spark, sf).select("script", "layer", F.explode("flows").alias("f"))
    return flows.select(
        "script",
        "layer",
        F.explode("f.sources").alias("source"),
        "f.target",
        F.array_join("f.transformations", ",").alias("transformations"),
        "f.line",
    )


@query
def script_fallback_edges(spark, sf):
    """Scripts whose reads and writes have no variable in common: every read is linked to every write."""
    flows = script_flows(loose_scripts(spark, sf), fallback=True).select("script", F.explode("flows").alias("f"))
    return flows.select("script", F.explode("f.sources").alias("source"), "f.target")


@query
def script_transforms(spark, sf):
    return _scripts(spark, sf).select("script", F.explode("transformations").alias("transform"))


def _read_back(corpus: DataFrame, column: str, read: Callable) -> DataFrame:
    """A corpus written to one file per text and read again: path below the folder, length and digest of each."""
    root = scratch_path(corpus.sparkSession, "corpus")
    write_corpus(corpus, column, root)
    path = F.substring_index(F.col(column), root.rsplit("/", 1)[1], -1).alias("path")
    return read(corpus.sparkSession, root).select(path, F.length("source").alias("chars"), F.md5("source").alias("digest"))


@query
def script_files(spark, sf):
    return _read_back(loose_scripts(spark, sf), "script_path", read_scripts)


@query
def job_files(spark, sf):
    return _read_back(job_corpus(spark, sf), "dag_path", read_jobs)


@query
def script_variables(spark, sf):
    return _scripts(spark, sf).select("script", F.explode("variables").alias("name", "value"))


@query
def script_errors(spark, sf):
    failed = _scripts(spark, sf).filter(F.col("error").isNotNull())
    return failed.select("script", "script_path", F.substring_index("error", ":", 1).alias("kind"))


@query
def script_totals(spark, sf):
    return scan_totals(_scripts(spark, sf))


def _jobs(spark, sf) -> DataFrame:
    return job_defs(job_corpus(spark, sf))


@query
def job_definitions(spark, sf):
    return _jobs(spark, sf).select(
        "dag_file", "dag_id", "schedule", F.array_join("tags", ",").alias("tags"), "layer",
        F.col("error").isNotNull().alias("failed"),
    )


@query
def job_tasks(spark, sf):
    return _jobs(spark, sf).select("dag_file", F.explode("tasks").alias("t")).select("dag_file", "t.*")


@query
def job_dependencies(spark, sf):
    rows = _jobs(spark, sf).select("dag_file", F.explode("dependencies").alias("d"))
    return rows.select("dag_file", F.col("d.from").alias("from_task"), F.col("d.to").alias("to_task"))


@query
def job_scripts(spark, sf):
    return _jobs(spark, sf).select("dag_file", F.explode("scripts").alias("script"))


@query
def run_summary(spark, sf):
    scripts = cut(_scripts(spark, sf), "script-scan").df
    jobs = cut(_jobs(spark, sf), "job-scan").df
    tables = _catalog(spark, sf)
    nodes, edges = graph.build_graph(scripts, jobs, tables)
    return graph.run_summary(scripts, jobs, tables, nodes, edges)

"""The whole lake in one run: ingest, register, clean, marts, scan, graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions import names
from siltworks.operators import clean, marts
from siltworks.operators.graph import build_graph, run_summary
from siltworks.operators.jobs import job_defs
from siltworks.operators.scan import script_flows
from siltworks.sources import catalog as cat
from siltworks.sources.readers import read_jobs, read_scripts
from siltworks.sources.scratch import cut, scratch_scope
from siltworks.sources.sinks import STATUS, attempt, ingest, write_layer

RAW = [
    "sales_order_header", "sales_order_detail", "customer", "sales_territory", "product",
    "product_category", "product_subcategory", "person", "address",
]

# table name -> (operator, names of the input tables)
SILVER: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "orders": (clean.silver_orders, ["sales_order_header"]),
    "order_lines": (clean.silver_order_lines, ["sales_order_detail"]),
    "customers": (clean.silver_customers, ["customer", "person"]),
    "territories": (clean.silver_territories, ["sales_territory"]),
    "products": (clean.silver_products, ["product", "product_subcategory", "product_category"]),
    "addresses": (clean.silver_addresses, ["address"]),
}
GOLD: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "sales_by_territory": (marts.gold_sales_by_territory, ["orders", "territories"]),
    "sales_by_category": (marts.gold_sales_by_category, ["order_lines", "products"]),
    "sales_by_period": (marts.gold_sales_by_period, ["orders"]),
    "product_ranking": (marts.gold_product_ranking, ["order_lines", "products"]),
}
# Comments of the layers.
COMMENTS = {
    "bronze": "Capa Bronze - Datos crudos",
    "silver": "Capa Silver - Datos limpios",
    "gold": "Capa Gold - Cubos analiticos",
}


@dataclass
class LakeConfig:
    """Where the lake lives and what feeds it.

    ``sources`` holds (source, target), or (source, target, split) with a ``readers.Split`` that is handed to the reader.
    ``scripts`` and ``jobs`` are folders or corpus tables; without them no lineage is built.
    ``spanish`` writes silver and gold with Spanish table and column names.
    """

    root: str
    reader: Callable[..., DataFrame]
    sources: list[tuple] = field(default_factory=lambda: [(t, t) for t in RAW])
    scripts: str | DataFrame | None = None
    jobs: str | DataFrame | None = None
    prefix: str = "aw_"
    spanish: bool = False

    def layer(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def run_layer(
    spark: SparkSession,
    steps: dict[str, tuple[Callable[..., DataFrame], list[str]]],
    source: str,
    target: str,
    spanish: bool = False,
) -> DataFrame:
    """Run every table of a layer: read its inputs, apply the operator, write; one status row each."""

    def named(table: str) -> str:
        return names.TABLES.get(table, table) if spanish else table

    rows = []
    for name, (operator, inputs) in steps.items():

        def build() -> int:
            given = [spark.read.parquet(f"{source}/{named(i)}") for i in inputs]
            given = [names.to_english(df) for df in given] if spanish else given
            with scratch_scope(spark):
                made = operator(*given)
                return write_layer(names.to_spanish(made) if spanish else made, f"{target}/{named(name)}")

        rows.append((",".join(map(named, inputs)), named(name), *attempt(build)))
    return spark.createDataFrame(rows, STATUS)


def save_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """Publish both lineage tables: a new version of each, seen at once and whole; one status row per table."""
    return cat.publish_lineage_tables(spark, nodes, edges, base)


def run_lineage(
    spark: SparkSession,
    scripts: DataFrame,
    jobs: DataFrame,
    base: str,
    exclude: tuple[str, ...] = ("default", "information_schema"),
) -> DataFrame:
    """Scan both corpora and the catalog, build and save the graph; returns the run summary.

    The stored scans are deleted at the end.
    """
    with scratch_scope(spark):
        summary = _lineage(spark, scripts, jobs, base, exclude)
        return spark.createDataFrame(summary.collect(), summary.schema)  # one row


def _lineage(spark: SparkSession, scripts: DataFrame, jobs: DataFrame, base: str, exclude: tuple[str, ...]) -> DataFrame:
    flows = cut(script_flows(scripts), "script-scan").df
    defs = cut(job_defs(jobs), "job-scan").df
    tables = cat.scan_catalog(spark, exclude)
    nodes, edges = build_graph(flows, defs, tables)
    save_graph(spark, nodes, edges, base)
    saved = [spark.table(f"lineage.{t}") for t in ("lineage_metadata", "lineage_graph_edges")]
    return run_summary(flows, defs, tables, *saved)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_pipeline(spark: SparkSession, config: LakeConfig) -> DataFrame:
    """All steps in order; one row per table and step with its row count or whole error text.

    A failed table or a failed lineage step does not stop the others.
    """
    bronze, silver, gold = (config.layer(x) for x in ("bronze", "silver", "gold"))

    def named(tables: dict) -> list[str]:
        return [names.TABLES[t] if config.spanish else t for t in tables]

    def registered(layer: str, tables: list[str]) -> DataFrame:
        cat.create_layer(spark, layer, COMMENTS[layer])
        done = cat.register_layer(spark, layer, tables, config.layer(layer), config.prefix)
        return done.select(F.lit(f"register {layer}").alias("step"), "table", "rows", "error")

    def written(step: str, status: DataFrame) -> DataFrame:
        return status.select(F.lit(step).alias("step"), F.col("target").alias("table"), "rows", "error")

    report = [
        written("ingest", ingest(spark, config.sources, config.reader, bronze)),
        registered("bronze", [source[1] for source in config.sources]),
        written("clean", run_layer(spark, SILVER, bronze, silver, config.spanish)),
        registered("silver", named(SILVER)),
        written("marts", run_layer(spark, GOLD, silver, gold, config.spanish)),
        registered("gold", named(GOLD)),
    ]
    if config.scripts is not None and config.jobs is not None:
        scripts = read_scripts(spark, config.scripts) if isinstance(config.scripts, str) else config.scripts
        jobs = read_jobs(spark, config.jobs) if isinstance(config.jobs, str) else config.jobs
        try:
            summary = run_lineage(spark, scripts, jobs, config.layer("lineage"))
        except Exception as e:  # the report of the earlier steps must not be lost
            failed = [("lineage", None, None, str(e))]
            return _together([*report, spark.createDataFrame(failed, "step string, `table` string, rows bigint, error string")])
        counts = [F.struct(F.lit(c).alias("table"), F.col(c).alias("rows")) for c in summary.columns]
        pairs = F.explode(F.array(*counts))
        report.append(
            summary.select(pairs.alias("p")).select(
                F.lit("lineage").alias("step"), "p.table", "p.rows", F.lit(None).cast("string").alias("error")
            )
        )
    return _together(report)

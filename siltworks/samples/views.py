"""Inputs of the operators as SQL over the given tables.

The texts run unchanged on Spark and on DuckDB. ``{name}`` refers to a given table or to another
view. No row of a given table is left out: a missing partner is made by giving the row a key that
nothing refers to, so every view grows with its tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _entity(layer: str, kind: str, key: str, table: str) -> str:
    """Node rows of one kind: every 17th has a stale id, every 9th is no catalog table."""
    name = f"concat(CASE WHEN {key} % 17 = 0 THEN 'old_' ELSE '' END, '{kind}_', {key})"
    return f"""SELECT concat('hive://{layer}.', {name}) AS node_id,
  CASE WHEN {key} % 9 = 0 THEN 'dataset' ELSE 'hive_table' END AS node_type,
  '{layer}' AS layer, '{layer}' AS database, {name} AS table_name, concat('{layer}.', {name}) AS full_name,
  concat('s3a://lake/{layer}/{kind}_', {key}, CASE WHEN {key} % 2 = 0 THEN '/' ELSE '' END) AS location,
  'parquet' AS format, CAST({key} * 3 AS BIGINT) AS row_count,
  CAST(CASE WHEN {key} % 6 = 0 THEN 0 ELSE 2 END AS BIGINT) AS column_count,
  CASE WHEN {key} % 6 = 0 THEN 'not json'
    ELSE concat('[{{{{"name":"id","type":"bigint"}}}},{{{{"name":"v', {key} % 3, '","type":"string"}}}}]') END AS columns_json,
  '' AS scanned_at, CAST({key} AS BIGINT) AS k
FROM {{{table}}}"""


def _links(source: str, target: str, key: str, layer: str, table: str) -> str:
    return f"""SELECT {source} AS source_id, {target} AS target_id, concat('job_', {key} % 7, '.py') AS script,
  CASE WHEN {key} % 5 = 0 THEN '' ELSE concat('dag_', {key} % 3) END AS dag_id, '{layer}' AS layer,
  CASE {key} % 4 WHEN 0 THEN 'select,withColumn' WHEN 1 THEN 'join, groupBy,agg' WHEN 2 THEN 'filter' ELSE '' END
    AS transformations, CAST({key} AS BIGINT) AS k
FROM {table}"""


VIEWS = {
    # ---- source tables ------------------------------------------------------------------
    "raw_order_header": """
SELECT o_orderkey AS SalesOrderID, o_orderdate AS OrderDate, o_orderdate + INTERVAL '12' DAY AS DueDate,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL '7' DAY END AS ShipDate,
  CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 1 ELSE 3 END AS Status,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE substring(o_orderpriority, 1, 1) IN ('1', '2') END AS OnlineOrderFlag,
  o_custkey AS CustomerID,
  CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN NULL ELSE o_custkey % 10 END AS SalesPersonID,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE c_nationkey END AS TerritoryID,
  CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.90 AS DECIMAL(3,2)) AS SubTotal,
  CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.08 AS DECIMAL(3,2)) AS TaxAmt,
  CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(3,2)) AS Freight,
  CAST(o_totalprice AS DECIMAL(14,4)) AS TotalDue
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "raw_order_detail": """
SELECT l_orderkey * 10 + l_linenumber AS SalesOrderDetailID, l_orderkey AS SalesOrderID, l_partkey AS ProductID,
  CAST(l_quantity AS INT) AS OrderQty,
  CAST(floor(l_extendedprice * 10000 / l_quantity) AS DECIMAL(12,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS UnitPrice,
  CAST(l_discount AS DECIMAL(4,2)) AS UnitPriceDiscount,
  CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS LineTotal
FROM {lineitem}""",
    "raw_customer": """
SELECT c_custkey AS CustomerID, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS PersonID,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END AS StoreID, c_nationkey AS TerritoryID
FROM {customer}""",
    "raw_person": """
SELECT CASE WHEN c_custkey % 6 = 5 THEN -c_custkey ELSE c_custkey END AS BusinessEntityID,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Customer' END AS FirstName, substring(c_name, 10) AS LastName,
  CAST(c_custkey % 3 AS INT) AS EmailPromotion
FROM {customer}""",
    "raw_territory": """
SELECT CASE WHEN n_nationkey = 24 THEN 124 ELSE n_nationkey END AS TerritoryID, n_name AS Name,
  substring(n_name, 1, 2) AS CountryRegionCode, r_name AS "Group"
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "raw_product": """
SELECT CASE WHEN p_partkey % 10 = 0 THEN -1 - p_partkey ELSE p_partkey END AS ProductID, p_name AS Name,
  concat('P-', p_partkey) AS ProductNumber, split_part(p_name, ' ', 1) AS Color,
  CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.615 AS DECIMAL(4,3)) AS StandardCost,
  CAST(p_retailprice AS DECIMAL(12,2)) AS ListPrice, CAST(p_size AS STRING) AS Size,
  CAST(NULL AS DOUBLE) AS Weight,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(substring(p_brand, 7) AS INT) END AS ProductSubcategoryID
FROM {part}""",
    "raw_subcategory": """
SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) AS ProductSubcategoryID,
  CAST(substring(p_brand, 7) AS INT) % 5 AS ProductCategoryID, p_brand AS Name
FROM {part}""",
    "raw_category": """
SELECT CASE WHEN r_regionkey = 4 THEN 104 ELSE r_regionkey END AS ProductCategoryID, r_name AS Name FROM {region}""",
    "raw_address": """
SELECT s_suppkey AS AddressID, s_name AS AddressLine1, n_name AS City, s_nationkey AS StateProvinceID,
  lpad(CAST(s_suppkey AS STRING), 5, '0') AS PostalCode
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # ---- lineage graph ------------------------------------------------------------------
    "links": "\nUNION ALL\n".join(
        [
            _links("concat('hive://bronze.part_', l_partkey)", "concat('hive://silver.order_', l_orderkey)",
                   "l_partkey", "bronze_to_silver", "(SELECT DISTINCT l_partkey, l_orderkey FROM {lineitem}) AS pairs"),
            _links("concat('hive://silver.order_', o_orderkey)", "concat('hive://silver.customer_', o_custkey)",
                   "o_orderkey", "unknown", "{orders}"),
            _links("concat('hive://silver.customer_', c_custkey)", "concat('hive://gold.nation_', c_nationkey)",
                   "c_custkey", "silver_to_gold", "{customer}"),
            _links("concat('hive://gold.nation_', n_nationkey)", "concat('hive://gold.region_', n_regionkey)",
                   "n_nationkey", "silver_to_gold", "{nation}"),
        ]
    ),
    # every 11th edge twice, every 13th node with a self loop
    "graph_edges": """
SELECT source_id, target_id, script, dag_id, layer, transformations, k FROM {links}
UNION ALL SELECT source_id, target_id, script, dag_id, layer, transformations, k FROM {links} WHERE k % 11 = 0
UNION ALL SELECT target_id, target_id, script, dag_id, layer, transformations, k FROM {links} WHERE k % 13 = 0""",
    "graph_nodes": "\nUNION ALL\n".join(
        [
            _entity("bronze", "part", "p_partkey", "part"),
            _entity("silver", "order", "o_orderkey", "orders"),
            _entity("silver", "customer", "c_custkey", "customer"),
            _entity("gold", "nation", "n_nationkey", "nation"),
            _entity("gold", "region", "r_regionkey", "region"),
        ]
    ),
    # ---- graph before datasets are merged into tables: ids of datasets are addresses ------
    "merge_nodes": """
SELECT concat('hive://bronze.part_', p_partkey) AS node_id, 'hive_table' AS node_type, 'bronze' AS layer,
  'bronze' AS database, concat('part_', p_partkey) AS table_name,
  concat(CASE WHEN p_partkey % 9 = 0 THEN 's3a://old/' ELSE 's3a://lake/' END, 'part_', p_partkey,
         CASE WHEN p_partkey % 2 = 0 THEN '//' ELSE '' END) AS location
FROM {part}
UNION ALL
SELECT concat('hive://bronze.later_', p_partkey), 'hive_table', 'bronze', 'bronze', concat('later_', p_partkey),
  CASE WHEN p_partkey % 3 = 0 THEN concat('s3a://lake/part_', p_partkey) ELSE '' END
FROM {part}
UNION ALL
SELECT concat('s3a://lake/part_', p_partkey), 'dataset', 'unknown', '', concat('part_', p_partkey),
  concat('s3a://lake/part_', p_partkey)
FROM {part}
UNION ALL
SELECT concat('s3a://lake/order_', o_orderkey), 'dataset', 'unknown', '', concat('order_', o_orderkey),
  concat('s3a://lake/order_', o_orderkey)
FROM {orders}""",
    "merge_edges": """
SELECT concat('s3a://lake/part_', l_partkey) AS source_id, concat('s3a://lake/order_', l_orderkey) AS target_id,
  concat('line_', l_linenumber, '.py') AS script
FROM {lineitem}""",
    # ---- graph before it is conformed: one name in several forms and layers ----------------
    "show_nodes": """
SELECT concat('hive://bronze.p_', p_partkey) AS node_id, CASE WHEN p_partkey % 5 = 0 THEN 'dataset' ELSE 'hive_table' END
  AS node_type, 'bronze' AS layer, concat('p_', p_partkey) AS table_name FROM {part}
UNION ALL SELECT concat('s3a://lake/p_', p_partkey), 'dataset', 'bronze', concat('p_', p_partkey) FROM {part}
UNION ALL SELECT concat('s3a://lake/', p_brand, '/all'), 'dataset', 'silver', concat('all_', p_brand)
  FROM (SELECT DISTINCT p_brand FROM {part}) AS brands
UNION ALL SELECT concat('hive://silver.o_', o_orderkey), 'hive_table',
  CASE WHEN o_orderkey % 8 = 0 THEN 'archive' WHEN o_orderkey % 8 = 1 THEN '' ELSE 'silver' END,
  concat('o_', o_orderkey) FROM {orders}
UNION ALL SELECT concat('hive://gold.o_', o_orderkey), 'hive_table', 'gold', concat('o_', o_orderkey) FROM {orders}""",
    "show_edges": """
SELECT CASE l_linenumber % 4 WHEN 0 THEN concat('hive://bronze.p_', l_partkey) WHEN 1 THEN concat('s3a://lake/p_', l_partkey)
    WHEN 2 THEN concat('hdfs://other/p_', l_partkey) ELSE concat('hdfs://other/gone_', l_partkey) END AS source_id,
  CASE WHEN l_linenumber = 7 THEN concat('hive://bronze.p_', l_partkey)
    ELSE concat('hive://silver.o_', l_orderkey) END AS target_id,
  CASE WHEN l_partkey % 6 = 0 THEN '' ELSE concat('job_', l_partkey % 7, '.py') END AS script,
  CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bronze_to_silver_sales' WHEN 2 THEN 'aw_silver_to_gold'
    ELSE 'ingesta_adventureworks' END AS dag_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'bronze_to_silver' ELSE 'unknown' END AS layer, 'select' AS transformations
FROM {lineitem}""",
    # ---- generated lineage and truth: each differs from the graph in its own tenth -----------
    "generated": """
SELECT CASE WHEN k % 4 = 0 THEN concat(upper(source_id), '/') ELSE source_id END AS source_id,
  CASE WHEN k % 10 = 1 THEN concat(target_id, '_x') ELSE target_id END AS target_id, script, transformations
FROM {graph_edges}""",
    "truth": """
SELECT source_id, CASE WHEN k % 10 = 0 THEN concat(' ', target_id, '_t/') ELSE concat(' ', target_id) END AS target_id,
  CASE WHEN k % 7 = 3 THEN 'nobody.py' ELSE script END AS script
FROM {graph_edges}""",
    "truth_ops": """
SELECT DISTINCT script, CASE WHEN k % 4 = 3 THEN 'trim' WHEN k % 4 = 2 THEN 'select' ELSE 'join' END AS transform
FROM {graph_edges}""",
    "truth_tables": """
SELECT layer, CASE WHEN k % 10 = 0 THEN concat(table_name, '_t') ELSE table_name END AS table_name FROM {graph_nodes}""",
}


def references(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])))


def _with_copies(links: DataFrame) -> DataFrame:
    """The graph_edges view in one pass over the links."""
    none = F.array().cast("array<string>")
    kinds = F.concat(
        F.array(F.lit("edge")),
        F.when(F.col("k") % 11 == 0, F.array(F.lit("edge"))).otherwise(none),
        F.when(F.col("k") % 13 == 0, F.array(F.lit("loop"))).otherwise(none),
    )
    loop = F.col("kind") == "loop"
    return (
        links.withColumn("kind", F.explode(kinds))
        .withColumn("source_id", F.when(loop, F.col("target_id")).otherwise(F.col("source_id")))
        .drop("kind")
    )


_schemas: dict[str, T.StructType] = {}


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def load(spark: SparkSession, sf: str, name: str, ready: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table or a view over them; views in ``ready`` are taken as they are."""
    if ready and name in ready:
        return ready[name]
    if name in TABLES:
        return given(spark, sf, name)
    if name == "graph_edges":
        return _with_copies(load(spark, sf, "links", ready))
    text = VIEWS[name].replace('"Group"', "`Group`")
    return spark.sql(text, **{r: load(spark, sf, r, ready) for r in references(name)})


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """The same views as a WITH clause in front of a DuckDB query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for r in references(name):
            if r not in TABLES:
                add(r)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)

    def text(name: str) -> str:
        return re.sub(r"\{\{|\}\}|\{(\w+)\}", lambda m: m.group(1) or m.group(0)[0], VIEWS[name])

    clauses = [f"{n} AS ({text(n)})" for n in ordered]
    joined = ",\n".join(clauses)
    sep = "," if body.lstrip().startswith("+") else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}{sep}\n{body.lstrip().removeprefix('+')}"

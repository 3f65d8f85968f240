"""The registered queries in SQL for DuckDB, written independently of the Spark operators."""

from __future__ import annotations

from siltworks.samples.frames import JOBS as JOB_TEXTS, LOOSE
from siltworks.samples.views import TABLES, with_views

ORACLES: dict[str, str] = {}


def add(name: str, views: list[str], body: str, recursive: bool = False) -> None:
    ORACLES[name] = with_views(views, body, recursive) if views else body.strip()


# ---- layers -----------------------------------------------------------------------------


def money(column: str) -> str:
    return f"CAST(round({column}, 2) AS DOUBLE)"


def cents(column: str) -> str:
    """Sum of a column with two decimals as an exact integer."""
    return f"CAST(sum({column}) * 100 AS HUGEINT)"


def half_up(numerator: str, count: str, scale: int) -> str:
    """numerator/count rounded half up to an integer, then divided by scale; exact for ties."""
    return f"CAST((2 * {numerator} + {count}) // (2 * {count}) AS DOUBLE) / {scale}.0"


ORDERS = f"""SELECT SalesOrderID AS order_id, OrderDate AS order_date, DueDate AS due_date, ShipDate AS ship_date,
  Status AS status, OnlineOrderFlag AS is_online, CustomerID AS customer_id, SalesPersonID AS salesperson_id,
  TerritoryID AS territory_id, {money('SubTotal')} AS subtotal, {money('TaxAmt')} AS tax,
  {money('Freight')} AS freight, {money('TotalDue')} AS total
FROM raw_order_header"""
add("silver_orders", ["raw_order_header"], ORDERS)

add("silver_order_lines", ["raw_order_detail"], f"""
SELECT SalesOrderDetailID AS line_id, SalesOrderID AS order_id, ProductID AS product_id, OrderQty AS quantity,
  {money('UnitPrice')} AS unit_price, CAST(UnitPriceDiscount AS DOUBLE) AS discount, {money('LineTotal')} AS line_total
FROM raw_order_detail""")

add("silver_customers", ["raw_customer", "raw_person"], """
SELECT CustomerID AS customer_id, PersonID AS person_id, StoreID AS store_id, TerritoryID AS territory_id,
  trim(coalesce(FirstName, '') || ' ' || coalesce(LastName, '')) AS full_name, EmailPromotion AS email_promo,
  CASE WHEN StoreID IS NULL THEN 'Individual' ELSE 'Tienda' END AS customer_type
FROM raw_customer LEFT JOIN raw_person ON PersonID = BusinessEntityID""")

add("silver_territories", ["raw_territory"], """
SELECT TerritoryID AS territory_id, Name AS territory, CountryRegionCode AS country_code, "Group" AS region_group
FROM raw_territory""")

PRODUCTS = """SELECT ProductID AS product_id, p.Name AS product, ProductNumber AS product_code, Color AS color,
  StandardCost, ListPrice, Size AS size, Weight AS weight, s.Name AS subcategory, c.Name AS category
FROM raw_product p LEFT JOIN raw_subcategory s ON p.ProductSubcategoryID = s.ProductSubcategoryID
LEFT JOIN raw_category c ON s.ProductCategoryID = c.ProductCategoryID"""
RAW_PRODUCTS = ["raw_product", "raw_subcategory", "raw_category"]
add("silver_products", RAW_PRODUCTS, f"""
SELECT product_id, product, product_code, color, {money('StandardCost')} AS standard_cost,
  {money('ListPrice')} AS list_price, size, weight, subcategory, category
FROM ({PRODUCTS})""")

add("silver_addresses", ["raw_address"], """
SELECT AddressID AS address_id, AddressLine1 AS address, City AS city, StateProvinceID AS state_id,
  PostalCode AS postal_code FROM raw_address""")

add("gold_sales_by_territory", ["raw_order_header", "raw_territory"], f"""
SELECT o.TerritoryID AS territory_id, Name AS territory, CountryRegionCode AS country_code, "Group" AS region_group,
  count(SalesOrderID) AS total_orders, count(DISTINCT CustomerID) AS unique_customers,
  CAST(sum(round(TotalDue, 2)) AS DOUBLE) AS total_revenue,
  {half_up(cents('round(TotalDue, 2)'), 'count(TotalDue)', 100)} AS avg_ticket,
  CAST(sum(round(Freight, 2)) AS DOUBLE) AS total_freight
FROM raw_order_header o LEFT JOIN raw_territory t ON o.TerritoryID = t.TerritoryID GROUP BY ALL""")

LINES = """SELECT SalesOrderDetailID AS line_id, ProductID AS product_id, OrderQty AS quantity,
  round(UnitPrice, 2) AS unit_price, UnitPriceDiscount AS discount, round(LineTotal, 2) AS line_total
FROM raw_order_detail"""
add("gold_sales_by_category", ["raw_order_detail", *RAW_PRODUCTS], f"""
SELECT category, subcategory, count(line_id) AS lines_sold, CAST(sum(quantity) AS BIGINT) AS units_sold,
  CAST(sum(line_total) AS DOUBLE) AS total_revenue, {half_up(cents('unit_price'), 'count(unit_price)', 100)} AS avg_price,
  {half_up('100 * ' + cents('discount'), 'count(discount)', 10000)} AS avg_discount
FROM ({LINES}) l LEFT JOIN ({PRODUCTS}) p ON l.product_id = p.product_id GROUP BY category, subcategory""")

add("gold_sales_by_period", ["raw_order_header"], f"""
SELECT year, quarter, month, total_orders, unique_customers, total_revenue, avg_ticket, online_orders, store_orders,
  CAST(round(CAST(online_orders / nullif(online_orders + store_orders, 0) * 100 AS DECIMAL(18,10)), 2) AS DOUBLE) AS pct_online
FROM (SELECT CAST(year(order_date) AS INT) AS year, CAST(quarter(order_date) AS INT) AS quarter,
    CAST(month(order_date) AS INT) AS month, count(order_id) AS total_orders,
    count(DISTINCT customer_id) AS unique_customers, CAST(sum(CAST(total AS DECIMAL(14,2))) AS DOUBLE) AS total_revenue,
    {half_up(cents('CAST(total AS DECIMAL(14,2))'), 'count(total)', 100)} AS avg_ticket,
    CAST(sum(CASE WHEN is_online = true THEN 1 ELSE 0 END) AS BIGINT) AS online_orders,
    CAST(sum(CASE WHEN is_online = false THEN 1 ELSE 0 END) AS BIGINT) AS store_orders
  FROM ({ORDERS}) GROUP BY 1, 2, 3)""")

RANKING = f"""SELECT product_id, product, category, subcategory, times_sold, units AS total_units,
  CAST(revenue AS DOUBLE) / 100.0 AS total_revenue, CAST(price AS DOUBLE) / 100.0 AS avg_price,
  round((10 * revenue - 6 * units * price) / 10.0) / 100.0 AS est_margin
FROM (SELECT l.product_id, product, category, subcategory, count(line_id) AS times_sold,
    CAST(sum(quantity) AS BIGINT) AS units, {cents('line_total')} AS revenue,
    (2 * {cents('unit_price')} + count(unit_price)) // (2 * count(unit_price)) AS price
  FROM ({LINES}) l LEFT JOIN ({PRODUCTS}) p ON l.product_id = p.product_id GROUP BY 1, 2, 3, 4)"""
add("gold_product_ranking", ["raw_order_detail", *RAW_PRODUCTS], RANKING)
add("gold_top_products", ["raw_order_detail", *RAW_PRODUCTS], RANKING + "\nORDER BY total_revenue DESC, product_id LIMIT 25")

# ---- ingest and catalog -----------------------------------------------------------------

COUNTS = "\nUNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)
add("ingest_status", [], f"SELECT t AS table_name, n AS rows, true AS ok FROM ({COUNTS})")
add("ingest_total", [], f"SELECT CAST(sum(n) AS BIGINT) AS total_rows FROM ({COUNTS})")
add("layer_registration", [], f"SELECT 'aw_' || t AS table_name, n AS rows, true AS ok FROM ({COUNTS})")
add("catalog_row_counts", [], f"SELECT t AS table_name, n AS row_count, 'parquet' AS format FROM ({COUNTS})")
LISTED = ", ".join(f"'{t}'" for t in TABLES)
COLUMNS = f"""SELECT DISTINCT table_name, CAST(ordinal_position - 1 AS INT) AS pos, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
    ELSE lower(data_type) END AS column_type
FROM information_schema.columns WHERE table_name IN ({LISTED})"""
add("catalog_columns", [], COLUMNS)
add("catalog_nodes", [], f"""
SELECT 'hive://given.' || t AS node_id, 'hive_table' AS node_type, 'given' AS layer, t AS table_name,
  'parquet' AS format, n AS row_count, column_count
FROM ({COUNTS}) JOIN (SELECT table_name, count(*) AS column_count FROM ({COLUMNS}) GROUP BY 1) ON t = table_name""")

# ---- graph build ------------------------------------------------------------------------

RECORDS = """records AS (
  SELECT l_orderkey AS k, concat('load_', l_orderkey % 50, '.py') AS script,
    concat('/etl/', l_orderkey, '/load_', l_orderkey % 50, '.py') AS script_path,
    concat('s3a://lake/silver/order_', l_orderkey - l_orderkey % 2) AS target
  FROM lineitem WHERE l_orderkey % 19 <> 0 GROUP BY l_orderkey)"""
add("dataset_nodes", [], f"""WITH {RECORDS}
SELECT target AS node_id, 'dataset' AS node_type, 'silver' AS layer, '' AS database, '' AS table_name,
  target AS full_name, target || '/' AS location, CASE WHEN k % 2 = 0 THEN 'parquet' ELSE 'csv' END AS format,
  CAST(0 AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS column_count, '[]' AS columns_json
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY script_path) AS rn FROM records) WHERE rn = 1""")
add("flow_edges", [], f"""WITH {RECORDS}, named AS (
  SELECT concat('load_', c_custkey % 45, '.py') AS script,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('dag_', c_custkey) END AS dag_id,
    row_number() OVER (PARTITION BY c_custkey % 45 ORDER BY c_custkey DESC) AS rn FROM customer)
SELECT DISTINCT concat('s3a://lake/bronze/part_', l_partkey) AS source_id, target AS target_id, r.script,
  coalesce(n.dag_id, '') AS dag_id, 'bronze_to_silver' AS layer,
  CASE WHEN k % 3 = 0 THEN 'select,join' ELSE 'select,filter' END AS transformations, k AS order_key
FROM records r JOIN lineitem ON l_orderkey = k LEFT JOIN named n ON n.script = r.script AND n.rn = 1""")
ORACLES["flow_edges"] = f"SELECT * EXCLUDE (order_key) FROM ({ORACLES['flow_edges']})"

PLACES = """+ places AS (
  SELECT rtrim(trim(location), '/') AS place, arg_max(node_id, table_name) AS home FROM merge_nodes
  WHERE node_type = 'hive_table' AND location <> '' GROUP BY 1)"""
add("merged_nodes", ["merge_nodes"], PLACES + """
SELECT * FROM merge_nodes WHERE NOT (node_type = 'dataset' AND node_id IN (SELECT place FROM places))""")
add("merged_edges", ["merge_nodes", "merge_edges"], PLACES + """
SELECT coalesce(s.home, source_id) AS source_id, coalesce(t.home, target_id) AS target_id, script
FROM merge_edges LEFT JOIN places s ON s.place = source_id LEFT JOIN places t ON t.place = target_id""")

GRAPH = ["graph_nodes", "graph_edges"]
add("dangling_edges", GRAPH, """
SELECT * FROM (SELECT source_id AS node_id, 'source' AS "end", count(*) AS edges FROM graph_edges GROUP BY 1
  UNION ALL SELECT target_id, 'target', count(*) FROM graph_edges GROUP BY 1)
WHERE node_id NOT IN (SELECT node_id FROM graph_nodes)""")

# ---- graph questions --------------------------------------------------------------------

add("graph_totals", GRAPH, """
SELECT (SELECT count(*) FROM graph_nodes) AS total_nodes, (SELECT count(*) FROM graph_edges) AS total_edges""")
add("graph_stats_nodes", ["graph_nodes"], "SELECT layer, count(*) AS total FROM graph_nodes GROUP BY layer")
add("graph_stats_edges", ["graph_edges"], "SELECT layer, count(*) AS total FROM graph_edges GROUP BY layer")
add("node_search", ["graph_nodes"], """
SELECT node_id, node_type, layer, table_name, full_name, format FROM graph_nodes
WHERE lower(node_id) LIKE '%r_1%' OR lower(table_name) LIKE '%r_1%' ORDER BY layer, table_name, node_id LIMIT 20""")
SUMMARY = "node_id, node_type, layer, table_name, full_name, format, row_count, column_count"
EDGE = "source_id, target_id, script, dag_id, layer, transformations"
add("nodes_by_layer", ["graph_nodes"], f"SELECT {SUMMARY} FROM graph_nodes WHERE layer = 'silver'")
add("edges_filtered", ["graph_edges"], f"""
SELECT {EDGE} FROM graph_edges WHERE layer = 'bronze_to_silver' AND dag_id = 'dag_1'""")
add("node_degrees", GRAPH, """
SELECT node_id, coalesce(u.n, 0) AS upstream_count, coalesce(d.n, 0) AS downstream_count FROM graph_nodes
LEFT JOIN (SELECT target_id, count(*) AS n FROM graph_edges GROUP BY 1) u ON u.target_id = node_id
LEFT JOIN (SELECT source_id, count(*) AS n FROM graph_edges GROUP BY 1) d ON d.source_id = node_id""")
add("node_detail_columns", ["graph_nodes"], """
SELECT node_id, location, format, CAST(NULL AS INT) AS pos, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS type
FROM graph_nodes WHERE k % 6 = 0
UNION ALL SELECT node_id, location, format, 0, 'id', 'bigint' FROM graph_nodes WHERE k % 6 <> 0
UNION ALL SELECT node_id, location, format, 1, 'v' || (k % 3), 'string' FROM graph_nodes WHERE k % 6 <> 0""")
add("subgraph_nodes", ["graph_nodes"], f"SELECT {SUMMARY} FROM graph_nodes WHERE layer = 'gold'")
add("subgraph_edges", ["graph_edges"], f"SELECT {EDGE} FROM graph_edges WHERE layer = 'silver_to_gold'")


def reach(seeds: str, near: str, far: str) -> str:
    return f"""+ walk(seed_id, node_id, hop) AS (
  SELECT seed, seed, 0 FROM ({seeds})
  UNION SELECT w.seed_id, e.{far}, w.hop + 1 FROM walk w JOIN graph_edges e ON e.{near} = w.node_id WHERE w.hop < 2),
best AS (SELECT seed_id, node_id, min(hop) AS hop FROM walk GROUP BY 1, 2)"""


for direction, seeds, near, far in (
    ("upstream", "SELECT concat('hive://silver.customer_', c_custkey) AS seed FROM customer", "target_id", "source_id"),
    ("downstream", "SELECT concat('hive://bronze.part_', p_partkey) AS seed FROM part", "source_id", "target_id"),
):
    walk = reach(seeds, near, far)
    add(f"{direction}_nodes", GRAPH, walk + """
SELECT seed_id, b.node_id, hop, layer, row_count FROM best b JOIN graph_nodes n ON n.node_id = b.node_id""", True)
    add(f"{direction}_edges", GRAPH, walk + f"""
SELECT DISTINCT seed_id, {EDGE} FROM best JOIN graph_edges ON {near} = node_id""", True)

# ---- conform ----------------------------------------------------------------------------

CANON = """+ placed AS (
  SELECT *, concat(layer, '|', split_part(split_part(node_id, '/', -1), '.', -1)) AS name_key,
    row_number() OVER (ORDER BY layer, table_name, node_id) AS pos FROM show_nodes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY (node_type = 'hive_table') DESC,
      CASE WHEN node_type = 'hive_table' THEN -pos ELSE pos END) AS rn,
    min(pos) OVER (PARTITION BY name_key) AS seen FROM placed),
winners AS (SELECT * FROM ranked WHERE rn = 1),
canon AS (SELECT p.node_id, w.node_id AS canonical_id FROM placed p JOIN winners w USING (name_key))"""
add("canonical_nodes", ["show_nodes"], CANON + "\nSELECT node_id, node_type, layer, table_name FROM winners")
add("canonical_map", ["show_nodes"], CANON + "\nSELECT node_id, canonical_id FROM canon")
RESOLVE = CANON + """, shown AS (
  SELECT *, regexp_replace(node_id, '[^a-zA-Z0-9_-]', '_', 'g') AS shown_id,
    list_position(['bronze', 'silver', 'gold', 'unknown'], CASE WHEN layer = '' THEN 'unknown' ELSE layer END) AS place
  FROM winners WHERE layer IN ('bronze', 'silver', 'gold', 'unknown', '')),
by_name AS (SELECT table_name, shown_id FROM
  (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY place, seen) AS nth FROM shown) WHERE nth = 1),
ids AS (SELECT source_id AS node_id FROM show_edges UNION SELECT target_id FROM show_edges),
keyed_ids AS MATERIALIZED (SELECT i.node_id, regexp_replace(c.canonical_id, '[^a-zA-Z0-9_-]', '_', 'g') AS canonical_key,
    regexp_replace(i.node_id, '[^a-zA-Z0-9_-]', '_', 'g') AS own_key,
    split_part(split_part(i.node_id, '/', -1), '.', -1) AS short
  FROM ids i LEFT JOIN canon c ON c.node_id = i.node_id),
shown_ids AS MATERIALIZED (SELECT DISTINCT shown_id FROM shown),
ends AS MATERIALIZED (SELECT i.node_id, coalesce(a.shown_id, b.shown_id, n.shown_id) AS shown_id FROM keyed_ids i
  LEFT JOIN shown_ids a ON a.shown_id = canonical_key
  LEFT JOIN shown_ids b ON b.shown_id = own_key
  LEFT JOIN by_name n ON n.table_name = short),
joined AS MATERIALIZED (SELECT s.shown_id AS source, t.shown_id AS target, e.* FROM (SELECT DISTINCT * FROM show_edges) e
  LEFT JOIN ends s ON s.node_id = source_id LEFT JOIN ends t ON t.node_id = target_id),
resolved AS (SELECT * FROM joined WHERE source <> target)"""
add("resolved_edges", ["show_nodes", "show_edges"], RESOLVE + "\nSELECT * FROM resolved")
add("typed_edges", ["show_nodes", "show_edges"], RESOLVE + """, typed AS (
  SELECT 'dag' AS edge_type, dag_id AS name, * FROM resolved WHERE dag_id <> ''
  UNION ALL SELECT 'script', script, * FROM resolved WHERE script <> '')
SELECT edge_type, source, target, name,
  CASE WHEN edge_type = 'script' THEN replace(name, '.py', '')
    WHEN name = 'ingesta_adventureworks' THEN 'Ingesta AW' WHEN name = 'aw_silver_to_gold' THEN 'S→G: AW'
    ELSE replace(name, 'bronze_to_silver_', 'B→S: ') END AS label,
  layer, dag_id, source_id, target_id, script, transformations
FROM (SELECT *, row_number() OVER (PARTITION BY edge_type, source, target, name
    ORDER BY layer, dag_id, source_id, target_id, script, transformations) AS nth FROM typed) WHERE nth = 1""")

# ---- quality ----------------------------------------------------------------------------


def norm(column: str) -> str:
    return f"lower(rtrim(trim({column}), '/'))"


def scores(by: str, items: str, gen: str, truth: str) -> str:
    """Confusion counts and scores from two item sets."""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}total_truth, total_generated, true_positives, false_positives, false_negatives,
  round_even(p * 100, 2) AS "precision", round_even(r * 100, 2) AS recall,
  round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 100, 2) AS f1
FROM (SELECT *, CASE WHEN total_generated > 0 THEN true_positives / total_generated ELSE 0.0::DOUBLE END AS p,
    CASE WHEN total_truth > 0 THEN true_positives / total_truth ELSE 0.0::DOUBLE END AS r
  FROM (SELECT {keys}count(t) AS total_truth, count(g) AS total_generated,
      count(*) FILTER (t AND g) AS true_positives, count(*) FILTER (g AND t IS NULL) AS false_positives,
      count(*) FILTER (t AND g IS NULL) AS false_negatives
    FROM (SELECT DISTINCT {items}, true AS g FROM ({gen})) FULL JOIN (SELECT DISTINCT {items}, true AS t FROM ({truth}))
      USING ({items}) {'GROUP BY ' + by if by else ''}))
{'WHERE total_truth > 0' if by else ''}"""


def ends(table: str) -> str:
    return f"SELECT script, {norm('source_id')} AS s, {norm('target_id')} AS d FROM {table}"


GEN_OPS = """SELECT script, trim(unnest(string_split(transformations, ','))) AS transform FROM generated
WHERE transformations <> ''"""
EDGE_Q = scores("", "s, d", ends("generated"), ends("truth"))
SCRIPT_Q = scores("script", "script, s, d", ends("generated"), ends("truth"))
OPS_Q = scores("script", "script, transform", GEN_OPS, "SELECT * FROM truth_ops")
NODE_Q = scores("layer", "layer, table_name", "SELECT layer, table_name FROM graph_nodes", "SELECT * FROM truth_tables")
add("edge_quality", ["generated", "truth"], EDGE_Q)
add("edge_outcomes", ["generated", "truth"], f"""
SELECT CASE WHEN g AND t THEN 'tp' WHEN g THEN 'fp' ELSE 'fn' END AS outcome, s AS source_id, d AS target_id
FROM (SELECT DISTINCT s, d, true AS g FROM ({ends('generated')}))
  FULL JOIN (SELECT DISTINCT s, d, true AS t FROM ({ends('truth')})) USING (s, d)""")
add("edge_quality_by_script", ["generated", "truth"], f"""
SELECT *, CASE WHEN f1 >= 100 THEN '✔' WHEN f1 >= 80 THEN '△' ELSE '✗' END AS mark FROM ({SCRIPT_Q})""")
add("transform_quality", ["generated", "truth_ops"], OPS_Q)
add("node_quality", ["graph_nodes", "truth_tables"], NODE_Q)
add("overall_quality", ["generated", "truth", "truth_ops", "graph_nodes", "truth_tables"], f"""
SELECT *, round_even((edge_f1 + script_f1 + transform_f1 + node_f1) / 4, 2) AS overall,
  CASE WHEN (edge_f1 + script_f1 + transform_f1 + node_f1) / 4 >= 95 THEN 'EXCELENTE'
    WHEN (edge_f1 + script_f1 + transform_f1 + node_f1) / 4 >= 85 THEN 'MUY BUENO'
    WHEN (edge_f1 + script_f1 + transform_f1 + node_f1) / 4 >= 70 THEN 'ACEPTABLE' ELSE 'NECESITA MEJORAS' END AS grade
FROM (SELECT (SELECT CAST(sum(CAST(f1 AS DECIMAL(9,2))) AS DOUBLE) / count(f1) FROM ({EDGE_Q})) AS edge_f1, (SELECT CAST(sum(CAST(f1 AS DECIMAL(9,2))) AS DOUBLE) / count(f1) FROM ({SCRIPT_Q})) AS script_f1,
  (SELECT CAST(sum(CAST(f1 AS DECIMAL(9,2))) AS DOUBLE) / count(f1) FROM ({OPS_Q})) AS transform_f1, (SELECT CAST(sum(CAST(f1 AS DECIMAL(9,2))) AS DOUBLE) / count(f1) FROM ({NODE_Q})) AS node_f1)""")

# ---- scans: what the script and job texts say follows from the key ------------------------

KEYED = """SELECT p_partkey AS k, p_partkey % 8 AS v, concat('job_', p_partkey, '.py') AS script,
  CASE p_partkey % 3 WHEN 0 THEN 'bronze_to_silver' WHEN 1 THEN 'ingesta' ELSE 'unknown' END AS layer FROM part"""
READS = f"""
SELECT script, concat('s3a://bronze/zone/t', k) AS path, 'parquet' AS format, 3 AS line, * FROM ({KEYED}) WHERE v = 0
UNION ALL SELECT script, concat('s3a://bronze/zone/u', k % 50), 'parquet', 4, * FROM ({KEYED}) WHERE v = 0
UNION ALL SELECT script, concat('s3a://bronze/zone/t', k), 'csv', 1, * FROM ({KEYED}) WHERE v = 1
UNION ALL SELECT script, concat('hive://db.t', k), 'table', 1, * FROM ({KEYED}) WHERE v = 2
UNION ALL SELECT script, concat('hive://a.x', k), 'sql', 1, * FROM ({KEYED}) WHERE v = 3
UNION ALL SELECT script, concat('hive://a.y', k), 'sql', 1, * FROM ({KEYED}) WHERE v = 3
UNION ALL SELECT script, concat('jdbc://sqlserver/shop/dbo.t', k), 'jdbc', 1, * FROM ({KEYED}) WHERE v = 4
UNION ALL SELECT script, concat('s3a://bronze/zone/t', k), 'parquet', 1, * FROM ({KEYED}) WHERE v = 7"""
WRITES = f"""
SELECT script, CASE WHEN v < 2 THEN concat('s3a://silver/zone/r', k) WHEN v < 4 THEN concat('hive://out.r', k)
    ELSE concat('s3a://bronze/shop/t', k) END AS path,
  CASE v WHEN 0 THEN 'parquet' WHEN 1 THEN 'orc' WHEN 2 THEN 'saveAsTable' WHEN 3 THEN 'insertInto' ELSE 'parquet' END AS format,
  CASE v WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 4 END AS line
FROM ({KEYED}) WHERE v < 5"""
OPS = "CASE v WHEN 0 THEN 'withColumn,select,join' WHEN 1 THEN 'filter' WHEN 2 THEN 'agg,groupBy' ELSE '' END"
add("script_reads", [], f"SELECT script, path, format, line FROM ({READS}) AS r(script, path, format, line, k, v, s2, layer)")
add("script_writes", [], WRITES)
add("script_flow_edges", [], f"""
SELECT r.script, r.layer, r.path AS source, w.path AS target, {OPS} AS transformations, w.line
FROM ({READS}) AS r(script, path, format, line, k, v, s2, layer) JOIN ({WRITES}) w ON w.script = r.script""")
add("script_transforms", [], f"""
SELECT script, transform FROM (SELECT script, unnest(string_split({OPS}, ',')) AS transform FROM ({KEYED}))
WHERE transform <> ''""")
add("script_variables", [], f"""
SELECT script, 'BASE' AS name, 's3a://bronze/zone' AS value FROM ({KEYED}) WHERE v = 0
UNION ALL SELECT script, 'OUT', 's3a://silver/zone' FROM ({KEYED}) WHERE v = 0""")
add("script_errors", [], f"""
SELECT script, concat('/etl/', CASE layer WHEN 'unknown' THEN 'other' ELSE layer END, '/', script) AS script_path,
  'SyntaxError' AS kind FROM ({KEYED}) WHERE v = 6""")
add("script_totals", [], f"""
SELECT count(*) AS scripts,
  CAST(sum(CASE WHEN v IN (0, 3) THEN 2 WHEN v IN (1, 2, 4, 7) THEN 1 ELSE 0 END) AS BIGINT) AS reads,
  count(*) FILTER (v < 5) AS writes, count(*) FILTER (v < 5) AS flows, count(*) FILTER (v = 6) AS errors
FROM ({KEYED})""")

JOBS = """SELECT s_suppkey AS k, s_suppkey % 4 AS v, concat('dag_', s_suppkey, '.py') AS dag_file FROM supplier"""
add("job_definitions", [], f"""
SELECT dag_file, CASE WHEN v < 2 THEN concat('dag_', k) END AS dag_id,
  CASE WHEN v = 0 THEN concat('0 ', k % 24, ' * * *') END AS schedule,
  CASE v WHEN 0 THEN concat('a,n', k % 3) WHEN 1 THEN 'b' ELSE '' END AS tags,
  CASE WHEN k % 2 = 0 THEN 'silver_to_gold' ELSE 'unknown' END AS layer, v = 3 AS failed FROM ({JOBS})""")
add("job_tasks", [], f"""
SELECT dag_file, concat('first_', k) AS task_id, 'BashOperator' AS operator,
  CASE WHEN v = 0 THEN concat('spark-submit /opt/airflow/scripts/x/job_', k % 7, '.py') ELSE 'true' END AS bash_command,
  CAST(NULL AS VARCHAR) AS application FROM ({JOBS}) WHERE v < 2
UNION ALL SELECT dag_file, concat('second_', k), 'BashOperator', '', NULL FROM ({JOBS}) WHERE v = 0
UNION ALL SELECT dag_file, concat('submit_', k), 'SparkSubmitOperator', NULL,
  concat('/opt/airflow/scripts/x/job_', k % 7, '.py') FROM ({JOBS}) WHERE v = 2""")
add("job_dependencies", [], f"""
SELECT dag_file, 't1' AS from_task, 't2' AS to_task FROM ({JOBS}) WHERE v < 2
UNION ALL SELECT dag_file, 't1 >> t2', 't3' FROM ({JOBS}) WHERE v = 1""")
add("job_scripts", [], f"""
SELECT dag_file, concat(prefix, 'scripts/x/job_', k % 7, '.py') AS script
FROM ({JOBS}), (VALUES (''), ('/opt/airflow/')) AS p(prefix) WHERE v IN (0, 2)
UNION ALL SELECT dag_file, concat('scripts/x/post_', k % 7, '.py') FROM ({JOBS}) WHERE v = 0""")
add("run_summary", [], f"""
SELECT count(*) AS scripts, (SELECT count(*) FROM supplier) AS jobs, CAST({len(TABLES)} AS BIGINT) AS tables,
  count(*) FILTER (v < 5) + {len(TABLES)} AS nodes,
  CAST(sum(CASE WHEN v IN (0, 3) THEN 2 WHEN v IN (1, 2, 4) THEN 1 ELSE 0 END) AS BIGINT) AS edges FROM ({KEYED})""")

add("script_fallback_edges", [], """
SELECT concat('loose_', s_suppkey, '.py') AS script, unnest([concat('s3a://bronze/loose/t', s_suppkey), concat('s3a://bronze/loose/u', s_suppkey % 7)]) AS source,
  concat('s3a://silver/loose/r', s_suppkey) AS target FROM supplier""")

# ---- what is written and read back -------------------------------------------------------


def filled(text: str, values: dict[str, str]) -> str:
    """A template of the corpora as SQL text with its tokens replaced."""
    out = "'" + text.replace("'", "''") + "'"
    for token, value in values.items():
        out = f"replace({out}, '{token}', CAST({value} AS VARCHAR))"
    return out


LOOSE_TEXT = filled(LOOSE, {"#K": "s_suppkey", "#M": "s_suppkey % 7"})
add("script_files", [], f"""
SELECT concat('/etl/loose_', s_suppkey, '.py') AS path, CAST(length(t) AS INT) AS chars, md5(t) AS digest
FROM (SELECT s_suppkey, {LOOSE_TEXT} AS t FROM supplier)""")
JOB_TEXT = "CASE s_suppkey % 4 " + " ".join(
    f"WHEN {v} THEN " + filled(text, {"#K": "s_suppkey", "#M": "s_suppkey % 7", "#H": "s_suppkey % 24", "#T": "s_suppkey % 3"})
    for v, text in enumerate(JOB_TEXTS)
) + " END"
add("job_files", [], f"""
SELECT concat('/dags/', CASE WHEN s_suppkey % 2 = 0 THEN 'silver_to_gold' ELSE 'other' END, '/dag_', s_suppkey, '.py') AS path,
  CAST(length(t) AS INT) AS chars, md5(t) AS digest FROM (SELECT s_suppkey, {JOB_TEXT} AS t FROM supplier)""")

STAMPED = [f"{layer}_{t}" for layer, tables in (
    ("silver", ["orders", "order_lines", "customers", "territories", "products", "addresses"]),
    ("gold", ["sales_by_territory", "sales_by_category", "sales_by_period", "product_ranking"]),
) for t in tables]
add("audit_stamps", [], "\nUNION ALL\n".join(
    f"SELECT '{t.split('_', 1)[1]}' AS table_name, count(*) AS rows, count(*) AS stamped FROM ({ORACLES[t]})" for t in STAMPED))
add("republished_layer", [], "SELECT p_partkey, upper(p_name) AS p_name FROM part")
add("catalog_table_read", [], "SELECT p_partkey, p_name FROM part")
add("catalog_lost_table", [], """
SELECT 'part' AS table_name, count(*) AS row_count, false AS failed FROM part UNION ALL SELECT 'supplier', NULL, true""")
add("catalog_node_details", [], f"""
SELECT table_name, table_name || '.parquet' AS folder,
  '[' || string_agg('{{"name":"' || column_name || '","type":"' || column_type || '"}}', ',' ORDER BY pos) || ']' AS columns_json
FROM ({COLUMNS}) GROUP BY table_name""")
add("saved_nodes", ["graph_nodes"], "SELECT node_id, node_type, layer, table_name, location, row_count FROM graph_nodes")
add("saved_edges", ["graph_edges"], "SELECT script, dag_id, layer, count(*) AS edges FROM graph_edges GROUP BY ALL")
MARK = "CASE WHEN f1 >= 100 THEN '✔' WHEN f1 >= 80 THEN '△' ELSE '✗' END"
COUNTED = "total_truth, total_generated, true_positives, false_positives, false_negatives, \"precision\", recall, f1"
NOTHING = ", ".join(f"CAST(NULL AS {t})" for t in ["BIGINT"] * 5 + ["DOUBLE"] * 2)
add("quality_report", [], f"""
SELECT 'overall' AS section, 'edges' AS name, {COUNTED}, {MARK} AS verdict FROM ({ORACLES['edge_quality']})
UNION ALL SELECT 'scripts', script, {COUNTED}, {MARK} FROM ({ORACLES['edge_quality_by_script']})
UNION ALL SELECT 'transforms', script, {COUNTED}, {MARK} FROM ({ORACLES['transform_quality']})
UNION ALL SELECT 'nodes', layer, {COUNTED}, {MARK} FROM ({ORACLES['node_quality']})
UNION ALL SELECT 'summary', name, {NOTHING}, f1, CASE name WHEN 'overall' THEN grade ELSE {MARK} END
FROM (SELECT grade, unnest(['edge_f1', 'script_f1', 'transform_f1', 'node_f1', 'overall']) AS name,
    unnest([edge_f1, script_f1, transform_f1, node_f1, overall]) AS f1 FROM ({ORACLES['overall_quality']}))""")

import pytest
from pyspark.sql import functions as F

from siltworks.operators import conform, graph

SCRIPTS = """script string, script_path string, layer string, reads array<struct<path:string>>,
writes array<struct<path:string,format:string,line:int>>,
flows array<struct<line:int,target:string,sources:array<string>,transformations:array<string>>>, error string"""
JOBS = "dag_id string, dag_path string, scripts array<string>"
CATALOG = """database string, `table` string, full_name string, columns array<struct<name:string,type:string>>,
location string, format string, layer string, error string, row_count bigint"""
SHOW = "node_id string, node_type string, layer string, table_name string"
EDGES = "source_id string, target_id string, script string, dag_id string, layer string, transformations string"


def record(path, target, sources, ops=("select", "join"), fmt="parquet", error=None):
    return (path.rsplit("/", 1)[-1], path, "unknown", [], [(target, fmt, 1)], [(1, target, list(sources), list(ops))], error)


def table(name, location, columns=(("id", "int"),), rows=5, fmt="parquet"):
    db, short = name.split(".")
    return (db, short, name, list(columns), location, fmt, db, None, rows)


def test_build_merges_datasets_into_catalog_tables(spark, rows):
    scripts = spark.createDataFrame(
        [
            record("/b/two.py", "s3a://silver/x/", ["s3a://bronze/a/", "s3a://bronze/b", "", "s3a://silver/x"]),
            record("/a/one.py", "s3a://silver/x", ["s3a://bronze/a"], fmt="csv"),
            record("/a/bad.py", "s3a://silver/never", ["s3a://bronze/a"], error="SyntaxError: x"),
            record("/a/free.py", "s3a://Silver/gold_y", ["s3a://silver/x"], ops=[]),
        ],
        SCRIPTS,
    )
    jobs = spark.createDataFrame(
        [("old", "/d/1.py", ["scripts/two.py"]), ("new", "/d/2.py", ["/x/two.py", "one.py"]), (None, "/d/3.py", ["x/one.py"])], JOBS
    )
    catalog = spark.createDataFrame(
        [table("bronze.a", "s3a://bronze/a/"), table("bronze.a2", "s3a://bronze/a"), table("silver.x", " s3a://silver/x// "),
         table("gold.none", None, columns=(), rows=None, fmt=None)],
        CATALOG,
    )
    nodes, edges = graph.build_graph(scripts, jobs, catalog)
    assert nodes.columns == graph.NODE_COLUMNS and edges.columns == graph.EDGE_COLUMNS
    assert rows(nodes, "node_id", "node_type", "layer", "format", "row_count", "column_count", "columns_json", "location") == sorted(
        [
            ("hive://bronze.a", "hive_table", "bronze", "parquet", 5, 1, '[{"name":"id","type":"int"}]', "s3a://bronze/a/"),
            ("hive://bronze.a2", "hive_table", "bronze", "parquet", 5, 1, '[{"name":"id","type":"int"}]', "s3a://bronze/a"),
            ("hive://gold.none", "hive_table", "gold", "parquet", 0, 0, "[]", ""),
            ("hive://silver.x", "hive_table", "silver", "parquet", 5, 1, '[{"name":"id","type":"int"}]', " s3a://silver/x// "),
            ("s3a://Silver/gold_y", "dataset", "gold", "parquet", 0, 0, "[]", "s3a://Silver/gold_y"),
        ],
        key=repr,
    )
    assert rows(edges, "source_id", "target_id", "script", "dag_id", "transformations") == sorted(
        [
            ("hive://bronze.a2", "hive://silver.x", "two.py", "new", "select,join"),
            ("s3a://bronze/b", "hive://silver.x", "two.py", "new", "select,join"),
            ("hive://bronze.a2", "hive://silver.x", "one.py", "", "select,join"),
            ("hive://silver.x", "s3a://Silver/gold_y", "free.py", "", ""),
        ],
        key=repr,
    )
    assert rows(graph.dangling_edges(nodes, edges)) == [("s3a://bronze/b", "source", 1)]
    assert tuple(graph.run_summary(scripts, jobs, catalog, nodes, edges).first()) == (4, 3, 4, 5, 4)


def test_the_first_write_describes_a_dataset(spark, rows):
    scripts = spark.createDataFrame([record("/b.py", "s3a://o/t/", ["x"]), record("/a.py", "s3a://o/t", ["x"], fmt="orc")], SCRIPTS)
    assert rows(graph.dataset_nodes(scripts), "node_id", "format", "table_name") == [("s3a://o/t", "orc", "t")]


def test_large_side_path_gives_the_same_graph(spark, rows, unbroadcast):
    n = F.col("id")
    sources = F.array(F.concat(F.lit("s3a://b/"), n % 7), F.lit("s3a://b/hub/"))
    scripts = spark.range(200).select(
        F.when(n % 2 == 0, "hot.py").otherwise(F.concat(F.lit("s"), n, F.lit(".py"))).alias("script"),
        F.concat(F.lit("/p/"), n).alias("script_path"),
        F.lit("unknown").alias("layer"),
        F.array(F.struct(F.lit("s3a://o/t").alias("path"), F.lit("orc").alias("format"), F.lit(1).alias("line"))).alias("writes"),
        F.array(
            F.struct(F.lit(1).alias("line"), F.lit("s3a://o/t").alias("target"), sources.alias("sources"), F.array(F.lit("join")).alias("transformations"))
        ).alias("flows"),
        F.lit(None).cast("string").alias("error"),
    )
    jobs = spark.createDataFrame([("d", "/d", ["x/hot.py"])], JOBS)
    catalog = spark.createDataFrame([table("bronze.hub", "s3a://b/hub"), table("silver.t", "s3a://o/t")], CATALOG)
    nodes, edges = graph.build_graph(scripts, jobs, catalog)
    assert rows(nodes, "node_id") == [("hive://bronze.hub",), ("hive://silver.t",)]
    got = rows(edges.groupBy("source_id", "target_id", "dag_id").count())
    want = [(f"s3a://b/{i}", "hive://silver.t") for i in range(7)] + [("hive://bronze.hub", "hive://silver.t")]
    assert {r[:2] for r in got} == set(want) and sum(r[3] for r in got) == 400
    assert sum(r[3] for r in got if r[2] == "d") == 200


@pytest.mark.parametrize("small", [True, False])
def test_canonical_nodes_and_resolved_edges(spark, rows, small, request):
    if not small:
        request.getfixturevalue("unbroadcast")
    nodes = spark.createDataFrame(
        [
            ("s3a://lake/bronze/t", "dataset", "bronze", "t"),
            ("hive://bronze.t", "hive_table", "bronze", "t"),
            ("hive://other.t", "hive_table", "bronze", "t"),
            ("s3a://x/u", "dataset", "silver", "u"),
            ("s3a://y/u", "dataset", "silver", "u"),
            ("hive://gold.t", "hive_table", "gold", "t"),
            ("hive://lineage.z", "hive_table", "lineage", "z"),
            ("s3a://free/w", "dataset", "", "w"),
        ],
        SHOW,
    )
    kept, mapped = conform.canonical_nodes(nodes)
    assert {r[0] for r in rows(kept, "node_id")} == {"hive://other.t", "s3a://x/u", "hive://gold.t", "hive://lineage.z", "s3a://free/w"}
    named = dict(rows(mapped))
    assert named["s3a://lake/bronze/t"] == named["hive://bronze.t"] == "hive://other.t" and named["s3a://y/u"] == "s3a://x/u"
    assert {named[v] for v in named.values()} == set(named.values())  # canonical ids stand for themselves

    edges = spark.createDataFrame(
        [
            ("hive://bronze.t", "s3a://y/u", "a.py.py", "aw_silver_to_gold", "unknown", "x"),
            ("hive://bronze.t", "s3a://y/u", "a.py.py", "aw_silver_to_gold", "unknown", "x"),
            ("s3a://lake/bronze/t", "s3a://x/u", "b.py", "", "bronze_to_silver", ""),
            ("s3a://nowhere/t", "hive://gold.t", "", "bronze_to_silver_x", "unknown", ""),
            ("hive://bronze.t", "hive://other.t", "self.py", "", "unknown", ""),
            ("hive://lineage.z", "s3a://x/u", "hidden.py", "", "unknown", ""),
            ("s3a://free/w", "hive___gold_t", "direct.py", "", "unknown", ""),
        ],
        EDGES,
    )
    resolved = conform.resolve_edges(nodes, edges)
    assert rows(resolved, "source", "target", "script") == sorted(
        [
            ("hive___other_t", "s3a___x_u", "a.py.py"), ("hive___other_t", "s3a___x_u", "b.py"),
            ("hive___other_t", "hive___gold_t", ""), ("s3a___free_w", "hive___gold_t", "direct.py"),
        ],
        key=repr,
    )
    assert rows(conform.typed_edges(resolved), "edge_type", "source", "target", "label") == sorted(
        [
            ("dag", "hive___other_t", "s3a___x_u", "S→G: AW"), ("script", "hive___other_t", "s3a___x_u", "a.py"),
            ("script", "hive___other_t", "s3a___x_u", "b"), ("dag", "hive___other_t", "hive___gold_t", "B→S: x"),
            ("script", "s3a___free_w", "hive___gold_t", "direct"),
        ],
        key=repr,
    )

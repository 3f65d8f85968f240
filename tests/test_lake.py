import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siltworks.functions import names
from siltworks.operators import quality
from siltworks.operators.jobs import job_defs
from siltworks.operators.scan import script_flows
from siltworks.plans import pipeline
from siltworks.samples.views import load
from siltworks.sources import catalog as cat
from siltworks.sources.readers import Split, jdbc_options, plan_split, read_jobs, read_scripts
from siltworks.sources.scratch import cut, scratch_scope, shared_folder
from siltworks.sources.sinks import ingest, shortened, total_rows, write_layer, write_report

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# One read per line, one write per table; the shape of a layered lake in our own words.
TO_SILVER = {
    "orders": ["sales_order_header"], "order_lines": ["sales_order_detail"], "customers": ["customer", "person"],
    "territories": ["sales_territory"], "products": ["product", "product_subcategory", "product_category"], "addresses": ["address"],
}
TO_GOLD = {
    "sales_by_territory": ["orders", "territories"], "sales_by_category": ["order_lines", "products"],
    "sales_by_period": ["orders"], "product_ranking": ["order_lines", "products"],
}


def script(source, target, steps, ending):
    text = [f'IN = "{source}"', f'OUT = "{target}"']
    for name, inputs in steps.items():
        text += [f'{name}_{i} = spark.read.parquet(f"{{IN}}/{t}/")' for i, t in enumerate(inputs)]
        chain = f"{name}_0" + "".join(f'.join({name}_{i}, "id", "left")' for i in range(1, len(inputs)))
        text += [f"made = {chain}{ending}", f'made.write.mode("overwrite").parquet(f"{{OUT}}/{name}/")']
    return "\n".join(text)


LOOP = """for name in TABLES:
    df = spark.read.format("jdbc").option("url", URL).option("dbtable", name).load()
    df.write.mode("overwrite").parquet(f"{OUT}/{name}/")
"""
JOB = 'with DAG(dag_id="{0}", schedule_interval=None) as dag:\n    a = BashOperator(task_id="run", bash_command=S + "/opt/airflow/scripts/{0}.py")\n'


def truth_of(steps, source, target, script_name):
    return [(f"hive://{source}.aw_{i}", f"hive://{target}.aw_{t}", script_name) for t, inputs in steps.items() for i in inputs]


@needs_data
@pytest.mark.parametrize("spanish", [False, True])
def test_whole_run_and_its_quality_score(spark, tmp_path, rows, spanish):
    root = str(tmp_path / "lake")
    silver_ending = '.select(col("x").alias("y")).withColumn("z", trim(col("y")))'
    gold_ending = '.groupBy("k").agg(count("x").alias("n")).withColumn("m", col("n")).orderBy("m")'
    to_silver, to_gold = TO_SILVER, TO_GOLD
    if spanish:
        to_silver = {names.TABLES[t]: i for t, i in TO_SILVER.items()}
        to_gold = {names.TABLES[t]: [names.TABLES[x] for x in i] for t, i in TO_GOLD.items()}
    files = {
        "scripts/bronze_to_silver/clean.py": script(f"file:{root}/bronze", f"file:{root}/silver", to_silver, silver_ending),
        "scripts/silver_to_gold/marts.py": script(f"file:{root}/silver", f"file:{root}/gold", to_gold, gold_ending),
        "scripts/ingesta_all.py": LOOP,
        "scripts/__init__.py": "x = 1",
        "scripts/lineage_engine/own.py": LOOP,
        "dags/dag_clean.py": JOB.format("clean"),
        "dags/dag_marts.py": JOB.format("marts"),
        "dags/other.py": JOB.format("never"),
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text.replace('"file:/', '"file:///'))
    views = {
        "sales_order_header": "raw_order_header", "sales_order_detail": "raw_order_detail", "customer": "raw_customer",
        "sales_territory": "raw_territory", "product": "raw_product", "product_category": "raw_category",
        "product_subcategory": "raw_subcategory", "person": "raw_person", "address": "raw_address",
    }
    for db in ("bronze", "silver", "gold", "lineage"):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    config = pipeline.LakeConfig(
        root,
        lambda s, t: load(s, SF, views[t]),
        scripts=str(tmp_path / "scripts"),
        jobs=str(tmp_path / "dags"),
        spanish=spanish,
    )
    report = pipeline.run_pipeline(spark, config).collect()
    assert [r for r in report if r["error"]] == []
    counts = {(r["step"], r["table"]): r["rows"] for r in report}
    pedidos = names.TABLES["orders"] if spanish else "orders"
    assert counts["ingest", "sales_order_header"] == counts["clean", pedidos] == counts["register silver", f"aw_{pedidos}"] == 1500
    assert counts["lineage", "scripts"] == 3 and counts["lineage", "jobs"] == 2 and counts["lineage", "nodes"] >= 19

    nodes, edges = (spark.table(f"lineage.{t}") for t in ("lineage_metadata", "lineage_graph_edges"))
    truth = truth_of(to_silver, "bronze", "silver", "clean.py") + truth_of(to_gold, "silver", "gold", "marts.py")
    known = spark.createDataFrame(truth, "source_id string, target_id string, script string")
    ops = {"clean.py": ["select", "withColumn", "join", "trim"], "marts.py": ["groupBy", "agg", "orderBy", "withColumn", "join", "filter"]}
    truth_ops = spark.createDataFrame([(s, o) for s, x in ops.items() for o in x], "script string, transform string")
    layers = {"bronze": pipeline.RAW, "silver": list(to_silver), "gold": list(to_gold)}
    truth_nodes = spark.createDataFrame([(k, f"aw_{t}") for k, x in layers.items() for t in x], "layer string, table_name string")

    edge = quality.edge_quality(edges, known)
    assert (edge.first()["true_positives"], edge.first()["f1"], edges.count()) == (16, 100.0, 16)
    by_script = quality.edge_quality_by_script(edges, known)
    transform = quality.transform_quality(edges, truth_ops)
    assert rows(transform, "script", "precision", "recall", "f1") == [("clean.py", 75.0, 75.0, 75.0), ("marts.py", 83.33, 83.33, 83.33)]
    node = quality.node_quality(nodes, truth_nodes)
    assert rows(node, "layer", "total_generated", "f1") == [("bronze", 9, 100.0), ("gold", 4, 100.0), ("silver", 6, 100.0)]
    overall = quality.overall_quality(edge, by_script, transform, node).first()
    assert (overall["transform_f1"], overall["overall"], overall["grade"]) == (pytest.approx(79.165), 94.79, "MUY BUENO")
    assert rows(edges, "script", "dag_id", "layer")[0] == ("clean.py", "clean", "bronze_to_silver")
    if spanish:
        gold = spark.table("gold.aw_ventas_por_territorio").columns
        assert gold[:5] == ["territorio_id", "territorio", "pais_codigo", "grupo", "total_pedidos"]
    write_report(edge, str(tmp_path / "report"))
    line = spark.read.text(str(tmp_path / "report")).first()[0]
    assert json.loads(line)["f1"] == 100.0


def test_ingest_isolates_failures(spark, tmp_path, rows):
    def reader(s, table):
        if table == "gone":
            raise ValueError("x" * 400)
        return s.range(7) if table == "a" else s.range(3).select((F.lit(1) / F.col("id")).alias("boom"))

    status = ingest(spark, [("a", "a"), ("gone", "b"), ("bad", "c")], reader, str(tmp_path))
    got = {r["source"]: r for r in status.collect()}
    assert (got["a"]["rows"], got["a"]["error"]) == (7, None)
    assert got["gone"]["error"] == "x" * 400 and got["bad"]["rows"] is None and len(got["bad"]["error"]) > 150
    assert {len(r["error"] or "") for r in shortened(status, 100).collect()} == {0, 100}
    assert total_rows(status).first()[0] == 7


def test_catalog_scan(spark, tmp_path, rows):
    nested = spark.createDataFrame([(1, [{"a": "x"}])], "id int, items array<struct<a:string>>")
    assert write_layer(nested, str(tmp_path / "t")) == 1
    cat.create_layer(spark, "cat_test", "it's a test")
    status = cat.register_layer(spark, "cat_test", ["t", "missing"], str(tmp_path))
    got = {r["table"]: r for r in status.collect()}
    assert (got["aw_t"]["rows"], got["aw_missing"]["rows"]) == (1, None)
    assert "PATH_NOT_FOUND" in got["aw_missing"]["error"]
    nested.createOrReplaceTempView("a_view")
    others = tuple(d for d in cat.list_databases(spark, ()) if d != "cat_test")
    row = cat.scan_catalog(spark, others).first()
    assert cat.scan_catalog(spark, others).count() == 1
    assert [tuple(c) for c in row["columns"]] == [("id", "int"), ("items", "array<struct<a:string>>")]
    assert (row["full_name"], row["format"], row["row_count"], row["layer"], row["error"]) == ("cat_test.aw_t", "parquet", 1, "cat_test", None)
    assert row["location"].endswith("/t")


def test_a_lost_table_keeps_its_row_with_an_error(spark, tmp_path):
    write_layer(spark.range(2), str(tmp_path / "ok"))
    cat.create_layer(spark, "cat_lost")
    cat.register_layer(spark, "cat_lost", ["ok"], str(tmp_path), prefix="")
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk" / "x.parquet").write_text("no parquet file")
    cat.register_table(spark, "cat_lost", "junk", str(tmp_path / "junk"), spark.range(1).schema)
    others = tuple(d for d in cat.list_databases(spark, ()) if d != "cat_lost")
    got = {r["table"]: r for r in cat.scan_catalog(spark, others).collect()}
    assert (got["ok"]["row_count"], got["ok"]["error"]) == (2, None)
    assert got["junk"]["row_count"] is None and len(got["junk"]["error"]) > 100


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "a.b", "id", (1, 1000), 16, user="u")
    assert options == {
        "url": "jdbc:x", "dbtable": "a.b", "user": "u", "partitionColumn": "id", "lowerBound": "1", "upperBound": "1000", "numPartitions": "16",
    }
    assert jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t"}
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")


def test_cut_counts_and_writes_to_the_shared_folder(spark):
    stored = cut(spark.createDataFrame([("ab", None), ("c", ["x"])], "a string, b array<string>"), "t")
    assert stored.rows == 2 and stored.bytes > 0 and stored.small
    assert shared_folder(spark) in stored.df.inputFiles()[0]


@needs_data
def test_corpus_readers_see_whole_files(spark, tmp_path):
    (tmp_path / "lineage_engine_like").mkdir()
    (tmp_path / "lineage_engine_like" / "a.py").write_text("x = 1\n\ny = 2\n")
    (tmp_path / "dag_b.py").write_text("z = 3\n")
    assert {r["script_path"].rsplit("/", 1)[-1]: r["source"] for r in read_scripts(spark, str(tmp_path)).collect()} == {
        "a.py": "x = 1\n\ny = 2\n", "dag_b.py": "z = 3\n",
    }
    assert [r["source"] for r in read_jobs(spark, str(tmp_path)).collect()] == ["z = 3\n"]
    assert script_flows(read_scripts(spark, str(tmp_path))).count() == 2


@needs_data
def test_file_names_with_blanks_and_accents(spark, tmp_path):
    root = tmp_path / "my dir"
    (root / "a b").mkdir(parents=True)
    names = ["año.py", "a+b.py", "c d.py", "100%.py"]
    for name in names:
        (root / "a b" / name).write_text("x = 1\n")
    (root / "__pycache__").mkdir()
    (root / "__pycache__" / "no.py").write_text("x = 1\n")
    (root / "dag_a.py").write_text("".join(f't = BashOperator(task_id="t", bash_command="python scripts/{n}")\n' for n in names if " " not in n))
    found = script_flows(read_scripts(spark, str(root)).filter("script_path NOT LIKE '%dag_a%'"))
    assert sorted(r["script"] for r in found.collect()) == sorted(names)
    jobs = job_defs(read_jobs(spark, str(root)))
    assert sorted(p.rsplit("/", 1)[-1] for p in jobs.first()["scripts"]) == sorted(n for n in names if " " not in n)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_bad_database_does_not_end_the_scan(spark, tmp_path, monkeypatch):
    write_layer(spark.range(2), str(tmp_path / "ok"))
    for db in ("cat_good", "cat_bad"):
        cat.create_layer(spark, db)
    cat.register_layer(spark, "cat_good", ["ok"], str(tmp_path), prefix="")
    tables = cat.list_tables

    def listed(s, db):
        if db == "cat_bad":
            raise ValueError("no such place")
        return tables(s, db)

    monkeypatch.setattr(cat, "list_tables", listed)
    others = tuple(d for d in cat.list_databases(spark, ()) if d not in ("cat_good", "cat_bad"))
    got = {r["database"]: r for r in cat.scan_catalog(spark, others).collect()}
    assert got["cat_good"]["row_count"] == 2 and got["cat_bad"]["error"] == "no such place" and got["cat_bad"]["table"] is None


def test_a_scope_leaves_nothing_behind(spark):
    outer = cut(spark.range(3), "outer")
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        inner = cut(spark.range(4), "inner")
        with scratch_scope(spark):
            innermost = cut(spark.range(5), "innermost")
        assert inner.df.count() == 4
        assert not os.path.exists(innermost.df.inputFiles()[0].removeprefix("file://"))
        left = inner.df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(left)
        1 / 0
    assert not os.path.exists(os.path.dirname(left)) and outer.df.count() == 3


def test_a_failed_lineage_step_keeps_the_report(spark, tmp_path):
    scripts = spark.createDataFrame([("/a.py", "x = 1")], "script_path string, wrong string")
    config = pipeline.LakeConfig(str(tmp_path / "lake"), lambda s, t: s.range(1), sources=[("a", "a")], scripts=scripts, jobs=scripts)
    report = pipeline.run_pipeline(spark, config).collect()
    assert [r["rows"] for r in report if r["step"] == "ingest"] == [1]
    assert [r["table"] for r in report if r["step"] == "lineage"] == [None] and report[-1]["error"]


@pytest.fixture
def failing(spark):
    """Rows whose last one cannot be made."""
    return spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 999, F.col("id")).otherwise(F.raise_error(F.lit("made to fail")).cast("bigint")).alias("id"))


def test_failed_write_keeps_the_old_rows(spark, tmp_path, failing):
    path = str(tmp_path / "layer")
    assert write_layer(spark.range(5), path) == 5
    with pytest.raises(Exception, match="made to fail"):
        write_layer(failing, path)
    assert spark.read.parquet(path).count() == 5
    assert write_layer(spark.read.parquet(path).union(spark.range(2)), path) == 7  # from itself
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["layer"]


def test_published_versions(spark, tmp_path, failing):
    cat.create_layer(spark, "versions")
    base = str(tmp_path / "a b" / "t")
    assert cat.publish(spark, "versions", "t", spark.range(3), base) == 3
    begun = spark.table("versions.t")
    assert cat.publish(spark, "versions", "t", begun.union(spark.range(10)), base) == 13
    assert (begun.count(), spark.table("versions.t").count()) == (3, 13)  # a reader that has begun goes on
    with pytest.raises(Exception, match="made to fail"):
        cat.publish(spark, "versions", "t", failing, base)
    assert spark.table("versions.t").count() == 13
    cat.publish(spark, "versions", "t", spark.range(2).withColumn("more", F.lit("x")), base)
    assert spark.table("versions.t").columns == ["id", "more"] and spark.table("versions.t").count() == 2
    assert len(list((tmp_path / "a b" / "t").iterdir())) == 2


def test_counts_of_many_tables_in_one_job(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "plain+x"))
    spark.range(9).withColumn("p", F.col("id") % 3).write.partitionBy("p").parquet(str(tmp_path / "parted y"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    paths = [f"file:{tmp_path}/plain+x", f"{tmp_path}/parted y/", f"file://{tmp_path}/empty"]
    assert cat.count_files(spark, paths) == {paths[0]: 7, paths[1]: 9}


@pytest.mark.parametrize("per_part", [100, 5000, 10**9])
def test_planned_split_gives_every_row_once(per_part):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t AS SELECT CASE WHEN i % 50 = 0 THEN NULL WHEN i % 3 = 0 THEN 7 ELSE i * i - 90 END AS k FROM range(20000) r(i)")
    split = plan_split(lambda q: duck.sql(q).fetchall(), "t", "k", per_part)
    sizes = [duck.sql(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in split.predicates()]
    assert sum(sizes) == 20000
    heavy = duck.sql("SELECT max(n) FROM (SELECT count(*) n FROM t GROUP BY k)").fetchall()[0][0]
    assert max(sizes) <= max(2 * per_part, 2 * heavy)
    assert (len(sizes) == 1) == (per_part == 10**9)


def test_split_reaches_the_reader(spark, tmp_path):
    seen = []

    def reader(session, table, split=None):
        seen.append((table, split))
        return session.range(3)

    split = Split("id", (10, 20))
    assert [r.rows for r in ingest(spark, [("a", "a"), ("b", "b", split)], reader, str(tmp_path)).collect()] == [3, 3]
    assert sorted(seen, key=str) == [("a", None), ("b", split)]
    assert split.predicates() == ["id < 10 OR id IS NULL", "id >= 10 AND id < 20", "id >= 20"]
    assert Split("d", ("o'x",)).predicates() == ["d < 'o''x' OR d IS NULL", "d >= 'o''x'"]


def test_tasks_write_the_files_of_a_corpus(spark, tmp_path, monkeypatch):
    from siltworks.sources import sinks

    monkeypatch.setattr(sinks, "_files", None)  # the driver touches no file
    rows = [("/a/one.py", "x = 1"), ("/a/two=%20 +.py", "y\n"), ("b.py", "first"), ("b.py", "second\n\n"), ("c.py", None), (None, "lost")]
    sinks.write_corpus(spark.createDataFrame(rows, "p string, source string"), "p", f"{tmp_path}/c/")
    found = {str(f.relative_to(tmp_path / "c")): f.read_text() for f in (tmp_path / "c").rglob("*") if f.is_file()}
    assert sorted(found.pop("b.py").split("\n")) == ["", "", "first", "second"]
    assert found == {"a/one.py": "x = 1\n", "a/two=%20 +.py": "y\n", "c.py": "\n", sinks.NO_NAME: "lost\n"}


def test_a_corpus_below_a_scheme_that_only_hadoop_knows(spark, tmp_path, monkeypatch):
    from siltworks.sources import sinks

    class Unknown:
        @staticmethod
        def from_uri(uri):
            raise sinks.pa.ArrowInvalid(uri)

    monkeypatch.setattr(sinks, "FileSystem", Unknown)
    sinks.write_corpus(spark.createDataFrame([("/a/one.py", "x = 1")], "p string, source string"), "p", f"{tmp_path}/c")
    assert (tmp_path / "c/a/one.py").read_text() == "x = 1\n"

import time

import pytest

from siltworks.operators.jobs import job_defs
from siltworks.operators.scan import scan_totals, script_flows


@pytest.fixture(scope="module")
def scanned(spark):
    """All snippets of this module in one corpus, one scan."""
    corpus = spark.createDataFrame(list(SNIPPETS.items()), "script_path string, source string")
    found = script_flows(corpus).collect()
    return {r["script_path"]: r for r in found}


SNIPPETS = {
    "names": """
A = "s3a://lake/a"
B = A + "/b"
C = f"{B}/{missing}"
D = f"{A}/d"
E = {"k": 1}["k"]
F = "plain_name"
G = "has blank"
H = CFG["x"]
A = "s3a://lake/later"
""",
    "late_value": """
P = "s3a://x/one"
a = spark.read.parquet(P)
P = "s3a://x/two/"
a.write.parquet("s3a://out/t")
""",
    "join": """
a = spark.read.parquet("s3a://in/a/")
b = spark_session.read.json("s3a://in/b")
c = a.join(b, "id")
d = c.filter("x")
d.write.mode("overwrite").parquet("s3a://out/d/")
c.write.orc("s3a://out/c")
c.write.orc("s3a://out/c")
""",
    "stale": """
a = spark.read.csv("s3a://in/a")
a = make()
a.write.csv("s3a://out/a")
""",
    "no_root": """
a = spark.read.parquet("s3a://in/a")
save(a).write.parquet("s3a://out/a")
func(x).write.parquet("s3a://out/b")
""",
    "sql": '''
q = spark.sql("""SELECT * from db.a x join db.b y""")
q.write.insertInto("db.c")
p = spark.sql("SELECT 1")
''',
    "formats": """
a = spark.read.format("delta").load("s3a://in/a")
b = spark.read.option("x", 1).load("s3a://in/b")
c = spark.read.table("db.c")
d = spark.readStream.format("parquet").load("s3a://in/d")
e = spark.read.parquet("relative/path")
a.write.format("iceberg").save("s3a://out/a")
b.write.save("s3a://out/b")
d.writeStream.format("parquet").start("s3a://out/d")
a.write.parquet("relative/out")
""",
    "jdbc": """
a = spark.read.format("jdbc").option("url", "jdbc:postgresql://h:5432/shop").option("dbtable", "s.t").load()
b = spark.read.format("jdbc").option("url", URL).option("dbtable", NAME).load()
a.write.format("jdbc").option("url", "jdbc:mysql://h/x/db1").option("dbtable", "t2").save()
""",
    "nested": """
def run(flag):
    if flag:
        a = spark.read.text("s3a://in/a")
        with ctx() as c:
            for i in x:
                a.write.text("s3a://out/a")
    try:
        b = spark.table("db.b")
    except ValueError:
        b.write.saveAsTable("db.c")
""",
    "other_targets": """
a, b = spark.read.parquet("s3a://in/a"), 1
c: object = spark.read.parquet("s3a://in/c")
d = e = spark.read.parquet("s3a://in/d")
x.y = spark.read.parquet("s3a://in/e")
f = [spark.read.parquet("s3a://in/f").select("x")]
f.write.parquet("s3a://out/f")
""",
    "ops": """
a = spark.read.parquet("s3a://in/a").select(col("x").alias("y")).where("z")
a.write.parquet("s3a://out/a")
", ".join(names)
trim(a)
a.repartition(3).write.parquet("s3a://out/b")
a.write.parquet("s3a://out/c")
""",
    "bad": "def broken(:",
    "null": "x = 1\0",
}


def flows(record):
    return [(f["target"], f["sources"], f["transformations"]) for f in record["flows"]]


def test_text_variables(scanned):
    assert scanned["names"]["variables"] == {
        "A": "s3a://lake/later", "B": "s3a://lake/a/b", "D": "s3a://lake/a/d", "F": "plain_name",
    }


def test_reads_use_the_last_value_of_a_variable(scanned):
    assert flows(scanned["late_value"]) == [("s3a://out/t", ["s3a://x/two"], [])]


def test_a_join_has_both_parents_and_writes_are_listed_once(scanned):
    r = scanned["join"]
    both = ["s3a://in/a", "s3a://in/b"]
    assert flows(r) == [
        ("s3a://out/d", both, ["join", "filter"]), ("s3a://out/c", both, ["join", "filter"]), ("s3a://out/c", both, ["join", "filter"]),
    ]
    assert [(w["path"], w["format"], w["line"]) for w in r["writes"]] == [("s3a://out/d", "parquet", 6), ("s3a://out/c", "orc", 7)]
    assert [(x["path"], x["format"], x["line"]) for x in r["reads"]] == [("s3a://in/a", "parquet", 2), ("s3a://in/b", "json", 3)]


def test_an_assignment_without_sources_keeps_the_old_ones(scanned):
    assert flows(scanned["stale"]) == [("s3a://out/a", ["s3a://in/a"], [])]


def test_without_a_known_root_every_name_counts(scanned):
    assert flows(scanned["no_root"]) == [("s3a://out/a", ["s3a://in/a"], []), ("s3a://out/b", [], [])]


def test_sql_tables(spark, scanned):
    assert flows(scanned["sql"]) == [("hive://db.c", ["hive://db.a", "hive://db.b"], [])]
    corpus = spark.createDataFrame([("sql", SNIPPETS["sql"])], "script_path string, source string")
    assert flows(script_flows(corpus, all_sql_tables=False).first()) == [("hive://db.c", ["hive://db.a"], [])]


def test_formats(scanned):
    r = scanned["formats"]
    assert [(x["path"], x["format"]) for x in r["reads"]] == [
        ("s3a://in/a", "delta"), ("s3a://in/b", "unknown"), ("hive://db.c", "table"), ("s3a://in/d", "parquet"),
    ]
    assert [(x["path"], x["format"]) for x in r["writes"]] == [("s3a://out/a", "iceberg"), ("s3a://out/b", "unknown")]


def test_jdbc_addresses(scanned):
    r = scanned["jdbc"]
    # the single slash after the host is taken by the address part, so no database is seen there
    assert [x["path"] for x in r["reads"]] == ["jdbc://s.t"]
    assert [x["path"] for x in r["writes"]] == ["jdbc://mysql/db1/t2"]


def test_blocks_are_walked_in_source_order(scanned):
    assert [(f["target"], f["sources"], f["line"]) for f in scanned["nested"]["flows"]] == [
        ("s3a://out/a", ["s3a://in/a"], 7), ("hive://db.c", ["hive://db.b"], 11),
    ]


def test_only_single_name_assignments_count(scanned):
    r = scanned["other_targets"]
    assert [x["path"] for x in r["reads"]] == ["s3a://in/f"]
    assert flows(r) == [("s3a://out/f", ["s3a://in/f"], ["select"])]


def test_transformations_pile_up_and_exclude_the_write_itself(scanned):
    r = scanned["ops"]
    first = ["where", "select", "alias"]
    assert [f[2] for f in flows(r)] == [first, [*first, "join"], [*first, "join", "repartition"]]
    assert r["transformations"] == [*first, "join", "repartition"]


def test_errors_are_rows(scanned):
    assert scanned["bad"]["error"].startswith("SyntaxError: ")
    assert scanned["null"]["error"] and scanned["bad"]["flows"] == []


def test_totals_and_layers(spark, scanned):
    corpus = spark.createDataFrame(
        [("/s/bronze_to_silver/a.py", SNIPPETS["join"]), ("/s/hive_register_x.py", "x = 1"), ("/s/b.py", SNIPPETS["bad"])],
        "script_path string, source string",
    )
    found = script_flows(corpus)
    assert tuple(scan_totals(found).first()) == (3, 2, 2, 3, 1)
    assert {r["script"]: r["layer"] for r in found.collect()} == {
        "a.py": "bronze_to_silver", "hive_register_x.py": "catalog", "b.py": "unknown",
    }


def test_job_definitions(spark):
    text = '''
ENV = "x"
with DAG(
    dag_id="nightly",
    schedule_interval=None,
    tags=["a", "b"],
) as dag:
    one = BashOperator(task_id="one", bash_command=ENV + "/opt/airflow/scripts/in/one.py", env=ENV)
    two = BashOperator(task_id="two", bash_command="run scripts/two.py")
    three = SparkSubmitOperator(task_id="three", application="app.py", conf={})
    four = SparkSubmitOperator(task_id="four")
    one >> two >> [three, four]
'''
    corpus = spark.createDataFrame(
        [("/d/silver_to_gold/dag_n.py", text), ("/d/dag_bad.py", "DAG(dag_id='x'")], "dag_path string, source string"
    )
    bad, good = sorted(job_defs(corpus).collect(), key=lambda r: r["dag_file"])
    assert (good["dag_id"], good["schedule"], good["tags"], good["layer"]) == ("nightly", None, ["a", "b"], "silver_to_gold")
    assert [tuple(t) for t in good["tasks"]] == [
        ("one", "BashOperator", "", None), ("two", "BashOperator", "run scripts/two.py", None),
        ("three", "SparkSubmitOperator", None, "app.py"), ("four", "SparkSubmitOperator", None, None),
    ]
    assert [tuple(d) for d in good["dependencies"]] == [("one >> two", "[three, four]"), ("one", "two")]
    assert good["scripts"] == ["/opt/airflow/scripts/in/one.py", "scripts/in/one.py", "scripts/two.py"]
    assert bad["error"] and bad["scripts"] == [] and bad["dag_id"] is None


def test_long_script_takes_work_in_proportion(spark):
    """Thousands of assignments, each of which follows the one before, with a write every few lines."""

    def script(n):
        lines = ['base = "s3a://bronze/zone"', 'd0 = spark.read.parquet(base + "/t0")']
        for k in range(1, n):
            lines.append(f'p{k} = base + "/t{k % 40}"')
            lines.append(f"d{k} = d{k - 1}.filter('x > {k}')" if k % 50 else f"d{k} = spark.read.parquet(p{k}).join(d{k - 1}, 'id')")
            if k % 25 == 0:
                lines.append(f'd{k}.write.parquet("s3a://silver/zone/r{k}")')
        return "\n".join(lines)

    def seconds(n):
        frame = spark.createDataFrame([("/etl/long.py", script(n))], "script_path string, source string")
        start = time.perf_counter()
        row = script_flows(frame).first()
        return time.perf_counter() - start, row

    _, small = seconds(200)
    took, row = seconds(5000)  # 10,000 statements
    assert len(row.flows) == 199 and len(small.flows) == 7
    assert row.flows[0].sources == ["s3a://bronze/zone/t0"] and row.flows[0].transformations == ["filter"]
    assert row.flows[1].sources == ["s3a://bronze/zone/t10"] and row.flows[1].transformations == ["filter", "join"]
    assert row.variables["p4999"] == "s3a://bronze/zone/t39" and len(row.variables) == 5000
    assert took < 20, took
    print("seconds", took)

"""Scan records and text corpora that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltworks.operators.skew import tasks
from siltworks.samples.views import load

SCRIPTS = [
    '''BASE = "s3a://bronze/zone"
OUT = "s3a://silver/zone"
a = spark.read.parquet(f"{BASE}/t#K/")
b = spark.read.parquet(BASE + "/u#M")
c = a.join(b, "id", "left").select("id").withColumn("x", b["y"])
c.write.mode("overwrite").parquet(f"{OUT}/r#K/")
''',
    '''src = spark.read.format("csv").load("s3a://bronze/zone/t#K/")
ok = src.filter("id > 0")
ok.write.format("orc").save("s3a://silver/zone/r#K")
''',
    '''t = spark.table("db.t#K")
u = t.groupBy("a").agg(f.sum("b"))
u.write.saveAsTable("out.r#K")
''',
    '''s = spark.sql("SELECT * FROM a.x#K JOIN a.y#K USING (id)")
s.write.insertInto("out.r#K")
''',
    '''j = (spark.read.format("jdbc")
     .option("url", "jdbc:sqlserver://host:1433;databaseName=shop;encrypt=false")
     .option("dbtable", "dbo.t#K").load())
j.write.parquet("s3a://bronze/shop/t#K")
''',
    '''for name in names:
    d = spark.read.parquet(f"s3a://bronze/{name}")
    d.write.parquet(f"s3a://silver/{name}")
''',
    """def broken(:
    x = #K
""",
    '''r = spark.read.parquet("s3a://bronze/zone/t#K")
done = r.write.parquet("s3a://silver/zone/r#K")
''',
]

JOBS = [
    '''with DAG(dag_id="dag_#K", schedule_interval="0 #H * * *", tags=["a", "n#T"]) as dag:
    t1 = BashOperator(task_id="first_#K", bash_command="spark-submit /opt/airflow/scripts/x/job_#M.py")
    t2 = BashOperator(task_id="second_#K", bash_command=PREFIX + "scripts/x/post_#M.py")
    t1 >> t2
''',
    '''dag = DAG(dag_id="dag_#K", schedule_interval=None, tags=["b"])
t1 = BashOperator(task_id="first_#K", bash_command="true", dag=dag)
t1 >> t2 >> t3
''',
    '''with DAG("unnamed", description="no dag_id given") as dag:
    s = SparkSubmitOperator(task_id="submit_#K", application="/opt/airflow/scripts/x/job_#M.py")
''',
    '''dag = DAG(dag_id="dag_#K"
t1 >> t2  # scripts/x/lost_#M.py
''',
]


def _fill(templates: list[str], key: Column, values: dict[str, Column]) -> Column:
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (key % len(templates) + 1).cast("int"))
    for token, value in values.items():
        text = F.replace(text, F.lit(token), value.cast("string"))
    return text


def script_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """One script per part."""
    k = F.col("p_partkey")
    stage = F.when(k % 3 == 0, "bronze_to_silver").when(k % 3 == 1, "ingesta").otherwise("other")
    # the table is one split: spread its keys, before they become texts
    return load(spark, sf, "part").select("p_partkey").repartition(tasks(load(spark, sf, "part"))).select(
        F.concat(F.lit("/etl/"), stage, F.lit("/job_"), k, F.lit(".py")).alias("script_path"),
        _fill(SCRIPTS, k, {"#K": k, "#M": k % 50}).alias("source"),
    )


LOOSE = '''a = spark.read.parquet("s3a://bronze/loose/t#K")
b = spark.read.csv("s3a://bronze/loose/u#M/")
made = build(rows)
made.write.parquet("s3a://silver/loose/r#K")
'''


def loose_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """One script per supplier that writes nothing it has read by name."""
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select(
        F.concat(F.lit("/etl/loose_"), k, F.lit(".py")).alias("script_path"), _fill([LOOSE], k, {"#K": k, "#M": k % 7}).alias("source")
    )


def job_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """One job definition per supplier."""
    k = F.col("s_suppkey")
    stage = F.when(k % 2 == 0, "silver_to_gold").otherwise("other")
    return load(spark, sf, "supplier").select(
        F.concat(F.lit("/dags/"), stage, F.lit("/dag_"), k, F.lit(".py")).alias("dag_path"),
        _fill(JOBS, k, {"#K": k, "#M": k % 7, "#H": k % 24, "#T": k % 3}).alias("source"),
    )


def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    """One script-scan record per order; its sources are the parts of its lines.

    Two neighbouring orders write one address. Some records failed, name an empty source, or read
    what they write.
    """
    parts = (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.collect_set(F.concat(F.lit("s3a://lake/bronze/part_"), "l_partkey", F.lit("/"))).alias("parts"))
    )
    k = F.col("k")
    target = F.concat(F.lit("s3a://lake/silver/order_"), k - k % 2, F.lit("/"))
    odd = F.concat(
        F.when(k % 13 == 0, F.array(target)).otherwise(F.array().cast("array<string>")),
        F.when(k % 23 == 0, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")),
    )
    script = F.concat(F.lit("load_"), k % 50, F.lit(".py"))
    fmt = F.when(k % 2 == 0, "parquet").otherwise("csv")
    ops = F.array(F.lit("select"), F.when(k % 3 == 0, "join").otherwise("filter"))
    return parts.select(
        script.alias("script"),
        F.concat(F.lit("/etl/"), k, F.lit("/"), script).alias("script_path"),
        F.lit("bronze_to_silver").alias("layer"),
        F.array(F.struct(target.alias("path"), fmt.alias("format"), F.lit(1).alias("line"))).alias("writes"),
        F.array(
            F.struct(
                F.lit(1).alias("line"),
                target.alias("target"),
                F.concat("parts", odd).alias("sources"),
                ops.alias("transformations"),
            )
        ).alias("flows"),
        F.when(k % 19 == 0, "SyntaxError: made").alias("error"),
    )


def job_records(spark: SparkSession, sf: str) -> DataFrame:
    """One job-scan record per customer; each names one script, the last by path wins it."""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("dag_"), k)).alias("dag_id"),
        F.concat(F.lit("/dags/dag_"), F.lpad(k.cast("string"), 12, "0"), F.lit(".py")).alias("dag_path"),
        F.array(F.concat(F.lit("/opt/airflow/scripts/load_"), k % 45, F.lit(".py"))).alias("scripts"),
    )

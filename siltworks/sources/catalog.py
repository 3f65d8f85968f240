"""Registers layers as external tables and scans the catalog."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siltworks.sources.sinks import attempt, remove, write_new

REGISTERED = "`table` string, rows bigint, error string"
CATALOG = """database string, `table` string, full_name string, columns array<struct<name:string,type:string>>,
location string, format string, layer string, error string"""
COUNTED_AT_ONCE = 100
VERSIONS = "published.versions"

# The comment of the lineage layer, and the column lists of its two tables.
LINEAGE_COMMENT = "Capa Lineage"
LINEAGE_TABLES = {
    "lineage_metadata": "node_id string, node_type string, layer string, database string, table_name string, "
    "full_name string, location string, format string, row_count bigint, column_count bigint, "
    "columns_json string, scanned_at string",
    "lineage_graph_edges": "source_id string, target_id string, script string, dag_id string, layer string, "
    "transformations string, scanned_at string",
}


def _quoted(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def create_layer(spark: SparkSession, name: str, comment: str = "") -> None:
    text = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)} COMMENT '{text}'")


def register_table(spark: SparkSession, db: str, table: str, path: str, schema: T.StructType | None = None) -> None:
    """External Parquet table over a directory, replacing an older registration."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(db, table)}")
    schema = schema or spark.read.parquet(path).schema
    spark.catalog.createTable(_quoted(db, table), path=path, source="parquet", schema=schema)


def publish(spark: SparkSession, db: str, table: str, df: DataFrame, base: str, keep: int = 2) -> int:
    """Write ``df`` as a new version below ``base`` and switch the catalog table to it; returns the number of rows.

    Readers see the rows of before or all new ones: the version is written completely before the table's location changes,
    and a failed write leaves the table as it is. The last ``keep`` versions stay, for readers that have begun.
    """
    base, name = base.rstrip("/"), _quoted(db, table)
    path = f"{base}/version-{uuid.uuid4().hex}"
    rows = write_new(df, path)
    there = spark.catalog.tableExists(name)
    known = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key") == VERSIONS).first() if there else None
    versions = json.loads(known["value"]) if known else []
    if there and spark.table(name).schema.simpleString() == df.schema.simpleString():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        register_table(spark, db, table, path, df.schema)
    left = [*versions, path][-keep:]
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{VERSIONS}' = '{json.dumps(left)}')")
    for old in versions:
        if old not in left:
            remove(spark, old)
    return rows


def _place(path: Column) -> Column:
    """A path without scheme and slashes at its end, to compare what the catalog and the file source call a folder."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/"), "/+$", "")


def count_files(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Rows below each path, all in one job whatever their columns: no column is read, tasks take the counts from footers.

    A path that holds no file is not listed. Folders of partitions (``name=value``) belong to the path above them.
    """
    # an empty schema: nothing is inferred on the driver and nothing but footers is read
    found = spark.read.schema(T.StructType([])).option("recursiveFileLookup", "true").parquet(*paths)
    # one row per file first: names are taken apart once for each of them
    files = found.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    file = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(F.regexp_replace(file, "/[^/]*$", ""), "(/[^/=]+=[^/]*)+$", "")
    counted = files.select(F.explode(F.array(_place(file), _place(folder))).alias("place"), "n").groupBy("place").agg(F.sum("n").alias("count"))
    wanted = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("place", _place(F.col("path")))
    # one row per path: the catalog's tables
    return {r.path: r["count"] for r in counted.join(F.broadcast(wanted), "place").collect()}


def count_tables(spark: SparkSession, names: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Row counts of tables of any format, many tables per job."""
    counts = {}
    for start in range(0, len(names), COUNTED_AT_ONCE):
        union = None
        for db, table in names[start : start + COUNTED_AT_ONCE]:
            one = spark.table(_quoted(db, table)).agg(F.count(F.lit(1)).alias("n"))
            one = one.select(F.lit(db).alias("db"), F.lit(table).alias("t"), "n")
            union = one if union is None else union.unionByName(one)
        counts |= {(r["db"], r["t"]): r["n"] for r in union.collect()}  # one row per table
    return counts


def count_each(
    spark: SparkSession, names: list[tuple[str, str]], parquet: dict[tuple[str, str], str] | None = None
) -> dict[tuple[str, str], tuple]:
    """(rows, error) per table: all in shared jobs, one by one only when a shared job fails.

    ``parquet`` gives the locations of Parquet tables; all of these are counted in one job from their footers.
    """
    found: dict[tuple[str, str], tuple] = {}
    if parquet:
        try:
            counts = count_files(spark, sorted(set(parquet.values())))
            found = {name: (counts[path], None) for name, path in parquet.items() if path in counts}
        except Exception:
            found = {}  # some location cannot be read; the tables are counted below
    left = [name for name in names if name not in found]
    try:
        return found | {name: (n, None) for name, n in count_tables(spark, left).items()}
    except Exception:
        return found | {name: attempt(lambda: count_tables(spark, [name])[name]) for name in left}


def _register(spark: SparkSession, db: str, tables: dict[str, tuple[str, T.StructType | None]]) -> DataFrame:
    """Register name -> (path, schema), then count what was registered; one status row per table."""
    errors = {}
    for name, (path, schema) in tables.items():

        def add() -> int:
            register_table(spark, db, name, path, schema)
            return 0

        errors[name] = attempt(add)[1]
    good = [n for n, e in errors.items() if e is None]
    counts = count_each(spark, [(db, n) for n in good], {(db, n): tables[n][0] for n in good})
    rows = [(n, *(counts[(db, n)] if e is None else (None, e))) for n, e in errors.items()]
    return spark.createDataFrame(rows, REGISTERED)


def register_layer(spark: SparkSession, db: str, tables: list[str], base: str, prefix: str = "aw_") -> DataFrame:
    """Register ``base/<table>`` as ``db.<prefix><table>``; one status row per table, with its whole error text."""
    base = base.rstrip("/")
    return _register(spark, db, {f"{prefix}{t}": (f"{base}/{t}", None) for t in tables})


def register_lineage_tables(spark: SparkSession, base: str, db: str = "lineage") -> DataFrame:
    """The node and edge tables with their fixed columns."""
    create_layer(spark, db, LINEAGE_COMMENT)
    base = base.rstrip("/")
    fixed = {t: (f"{base}/{t}", T.StructType.fromDDL(columns)) for t, columns in LINEAGE_TABLES.items()}
    return _register(spark, db, fixed)


def publish_lineage_tables(spark: SparkSession, nodes: DataFrame, edges: DataFrame, base: str, db: str = "lineage") -> DataFrame:
    """Publish the node and edge tables with their fixed columns; one status row per table."""
    create_layer(spark, db, LINEAGE_COMMENT)
    rows = []
    for (table, columns), df in zip(LINEAGE_TABLES.items(), (nodes, edges), strict=True):
        fixed = df.select([F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(columns).fields])
        rows.append((table, *attempt(lambda: publish(spark, db, table, fixed, f"{base.rstrip('/')}/{table}"))))
    return spark.createDataFrame(rows, REGISTERED)


def list_databases(spark: SparkSession, exclude: tuple[str, ...] = ("default", "information_schema")) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases() if d.name not in exclude]


def list_tables(spark: SparkSession, db: str) -> list[str]:
    return [t["tableName"] for t in spark.sql(f"SHOW TABLES IN {_quoted(db)}").collect() if not t["isTemporary"]]


def describe_columns(spark: SparkSession, db: str, table: str) -> list[dict[str, str]]:
    schema = spark.table(_quoted(db, table)).schema
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in schema.fields]


def describe_storage(spark: SparkSession, db: str, table: str) -> tuple[str | None, str | None]:
    """Location and format; a serde table is told by its input format."""
    text = spark.sql(f"DESCRIBE EXTENDED {_quoted(db, table)} AS JSON").first()[0]
    detail = json.loads(text)
    kind, reads_as = detail.get("provider"), detail.get("input_format") or ""
    if kind in (None, "hive"):
        kind = "parquet" if "Parquet" in reads_as else "csv" if "Text" in reads_as else kind
    return detail.get("location"), kind


def scan_catalog(spark: SparkSession, exclude: tuple[str, ...] = ("default", "information_schema")) -> DataFrame:
    """One row per catalog table: columns, location, format, row count; layer = database.

    A table that cannot be described or counted keeps its row, with the whole error text. A database whose tables cannot be
    listed gives one row without a table.
    """
    rows = []
    for db in list_databases(spark, exclude):
        try:
            tables = list_tables(spark, db)
        except Exception as e:
            rows.append((db, None, db, [], None, None, db, str(e)))
            continue
        for table in tables:
            columns, location, kind, error = [], None, None, None
            try:
                columns = describe_columns(spark, db, table)
                location, kind = describe_storage(spark, db, table)
            except Exception as e:
                error = str(e)
            rows.append((db, table, f"{db}.{table}", columns, location, kind, db, error))
    good = [r for r in rows if r[-1] is None]
    counts = count_each(spark, [(r[0], r[1]) for r in good], {(r[0], r[1]): r[4] for r in good if r[5] == "parquet" and r[4]})
    full = [(*r[:-1], r[-1] or counts[(r[0], r[1])][1], counts.get((r[0], r[1]), (None, None))[0]) for r in rows]
    return spark.createDataFrame(full, f"{CATALOG}, row_count bigint")

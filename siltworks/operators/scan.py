"""Data flows of PySpark scripts: a corpus table in, one scan record per script out.

Parsing yields statement records (``functions.syntax``), in which each name refers to the assignment that it means by its
number. Everything after that is Catalyst expressions over the statement array of the row: what an assignment holds is
found once and kept in an array by number, so that the work grows with the script, not with its square. Nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions.syntax import SCRIPT_DDL, parse_scripts
from siltworks.functions.text import last_part, no_slash, stage_of_script, storage_address

# Method names counted as transformations.
TRANSFORMS = [
    "groupBy", "filter", "where", "join", "withColumn", "withColumnRenamed",
    "select", "selectExpr", "agg", "orderBy", "sort", "sortWithinPartitions",
    "dropDuplicates", "distinct", "pivot", "unpivot",
    "union", "unionAll", "unionByName", "intersect", "intersectAll",
    "subtract", "exceptAll", "crossJoin",
    "explode", "explode_outer", "posexplode",
    "limit", "sample", "repartition", "coalesce",
    "fillna", "dropna", "na", "replace",
    "withWatermark", "alias", "toDF",
    "cache", "persist", "unpersist", "checkpoint",
    "hint", "broadcast",
]

# Text patterns of reads and writes. (?U) and (?d) give Unicode classes and plain
# newlines, as the patterns expect.
SPARK_TABLE = r"(?Ud)(?:spark\w*|sc)\.table\s*\("
SPARK_SQL = r"(?Ud)(?:spark\w*|sc)\.sql\s*\("
SPARK_READ = r"(?Ud)(?:spark\w*|sc)\.read"
TABLE_NAME = r"""(?Ud)\.table\s*\(\s*["']([^"']+)["']\s*\)"""
SQL_TEXT = r"""(?Uds)\.sql\s*\(\s*["'](.+?)["']\s*\)"""
SQL_TABLES = r"(?Uid)\b(?:FROM|JOIN)\s+(\w+\.\w+)"
FORMAT = r"""(?Ud)\.format\s*\(\s*["'](\w+)["']\s*\)"""
JDBC_TABLE = r"""(?Ud)(?:dbtable|table)["'],\s*["']([^"']+)["']"""
JDBC_URL = r"(?Ud)jdbc:(\w+)://([^/;]+)[/;].*?(?:databaseName=|/)(\w+)"
SAVE_AS = r"""(?Ud)\.saveAsTable\s*\(\s*["']([^"']+)["']\s*\)"""
INSERT_INTO = r"""(?Ud)\.insertInto\s*\(\s*["']([^"']+)["']\s*\)"""
PLAIN_NAME = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
FILE_FORMATS = ["parquet", "csv", "json", "orc", "text"]

ACCESS = "struct<paths:array<string>,format:string>"


def _held(values: Column, at: Column) -> Column:
    """What assignment number ``at`` (from 1) holds; NULL without one."""
    return F.get(values, at - 1)


def _resolve(parts: Column, known: Column) -> Column:
    """Text of an expression; NULL when it is not a text or a variable is unknown."""
    return F.aggregate(parts, F.lit(""), lambda text, p: F.concat(text, F.coalesce(p["text"], _held(known, p["at"]))))


def _known_texts(statements: Column) -> Column:
    """The text that each assignment's variable has behind it, by number; one that is no text keeps the text before."""

    def step(known: Column, s: Column) -> Column:
        value = F.when(s["target"].isNotNull() & s["value"].isNotNull(), _resolve(s["value"], known))
        # one-element array: the value is computed once and used by the lambda
        kept = F.transform(
            F.array(value),
            lambda v: F.when(
                F.contains(v, F.lit("/")) | F.contains(v, F.lit("jdbc:")) | F.rlike(v, F.lit(PLAIN_NAME)), v
            ).otherwise(_held(known, s["before"])),
        )
        return F.concat(known, kept)

    return F.aggregate(statements, F.array().cast("array<string>"), step)


def _variables(statements: Column, known: Column) -> Column:
    """Text variables of the script as they are at its end."""
    ends = F.transform(statements, lambda s, i: F.struct(s["target"].alias("key"), F.get(known, i).alias("value"), s["last"].alias("last")))
    named = F.filter(ends, lambda e: e["last"] & e["value"].isNotNull())
    return F.map_from_entries(F.transform(named, lambda e: F.struct(e["key"], e["value"])))


def _first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _hive(name: Column) -> Column:
    return F.concat(F.lit("hive://"), name)


def _jdbc(text: Column) -> Column:
    table, kind, database = _first_match(text, JDBC_TABLE), _first_match(text, JDBC_URL), _first_match(text, JDBC_URL, 3)
    named = F.concat(F.lit("jdbc://"), kind, F.lit("/"), database, F.lit("/"), table)
    return F.coalesce(named, F.concat(F.lit("jdbc://"), table))


def _access(path: Column, fmt: Column | str) -> Column:
    """Read or write of one path; NULL without a path."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.when(path.isNotNull(), F.struct(F.array(path).alias("paths"), fmt.alias("format"))).cast(ACCESS)


def _path_hits(s: Column, variables: Column) -> Column:
    """(method, address) for every call argument that is a storage address, outer calls first."""

    def of_call(c: Column) -> Column:
        texts = F.transform(c["args"], lambda a: _resolve(a, variables))
        return F.transform(
            F.filter(texts, lambda t: t.isNotNull() & storage_address(t)),
            lambda t: F.struct(c["method"].alias("method"), t.alias("path")),
        )

    return F.flatten(F.transform(s["calls"], of_call))


def _address(s: Column, method: str) -> Column:
    found = F.filter(s["hits"], lambda h: h["method"] == method)
    return no_slash(F.try_element_at(found, F.lit(1))["path"])


def _by_format(s: Column, generic: str) -> Column:
    """Address by ``format(..)`` plus the generic call, a format method, or the generic call alone."""
    text = s["text"]
    fmt = _first_match(text, FORMAT)
    named = [_access(F.when(F.contains(text, F.lit(f".{f}(")), _address(s, f)), f) for f in FILE_FORMATS]
    return F.coalesce(
        F.when(fmt.isNotNull(), _access(_address(s, generic), fmt)), *named, _access(_address(s, generic), "unknown")
    )


def _read(s: Column, all_sql_tables: bool) -> Column:
    text = s["text"]
    table = _access(_hive(_first_match(text, TABLE_NAME)), "table")
    names = F.regexp_extract_all(_first_match(text, SQL_TEXT), F.lit(SQL_TABLES), F.lit(1))
    tables = F.transform(names if all_sql_tables else F.slice(names, 1, 1), _hive)
    sql = F.when(F.size(tables) > 0, F.struct(tables.alias("paths"), F.lit("sql").alias("format"))).cast(ACCESS)
    return (
        F.when(s["target"].isNull() | text.isNull(), F.lit(None))
        .when(F.rlike(text, F.lit(SPARK_TABLE)), table)
        .when(F.rlike(text, F.lit(SPARK_SQL)), sql)
        .when(~F.rlike(text, F.lit(SPARK_READ)), F.lit(None))
        .when(F.contains(F.lower(text), F.lit("jdbc")), _access(no_slash(_jdbc(text)), "jdbc"))
        .otherwise(F.coalesce(_by_format(s, "load"), table))
    )


def _write(s: Column) -> Column:
    text = s["text"]
    jdbc = F.when(F.contains(F.lower(text), F.lit("jdbc")), _access(_jdbc(text), "jdbc"))
    found = F.coalesce(
        _access(_hive(_first_match(text, SAVE_AS)), "saveAsTable"),
        _access(_hive(_first_match(text, INSERT_INTO)), "insertInto"),
        jdbc,
        _by_format(s, "save"),
    )
    return F.when(s["target"].isNull() & F.contains(text, F.lit(".write")), found)


def _used_sources(held: Column, used: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(used, lambda at: _held(held, at))))


def _held_sources(events: Column) -> Column:
    """The addresses that each assignment's variable stands for behind it, by number; without any, those from before."""
    none = F.array().cast("array<string>")

    def step(held: Column, s: Column) -> Column:
        found = F.coalesce(s["read"]["paths"], _used_sources(held, s["used"]))
        new = F.transform(
            F.array(F.when(s["target"].isNotNull(), found)),
            lambda f: F.when(F.size(f) > 0, f).otherwise(F.coalesce(_held(held, s["before"]), none)),
        )
        return F.concat(held, new)

    return F.aggregate(events, F.array().cast("array<array<string>>"), step)


def _flows(events: Column, held: Column) -> Column:
    """What is written, and from which addresses: those of the variable that is written, else of all names there."""

    def flow(s: Column) -> Column:
        root = _held(held, s["root_at"])
        return F.struct(
            s["line"].alias("line"),
            s["write"]["paths"][0].alias("target"),
            F.when(F.size(root) > 0, root).otherwise(_used_sources(held, s["used"])).alias("sources"),
            s["at"].alias("at"),
        )

    return F.transform(F.filter(events, lambda s: s["write"].isNotNull()), flow)


def _seen_once(items: Column) -> Column:
    """The first record of every path, in order: records sorted by path, the first of each taken, sorted back."""
    numbered = F.array_sort(F.transform(items, lambda x, i: F.struct(x["path"].alias("path"), i.alias("i"), x.alias("x"))))
    return F.transform(
        F.array(numbered),
        lambda n: F.transform(
            F.array_sort(
                F.transform(
                    F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1)["path"] != x["path"])),
                    lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")),
                )
            ),
            lambda x: x["x"],
        ),
    )[0]


def _first_ops(statements: Column) -> Column:
    """(method, number of the statement that first names it) of every transformation, in order."""
    known = F.array(*[F.lit(t) for t in TRANSFORMS])
    every = F.flatten(
        F.transform(
            statements,
            lambda s, i: F.transform(
                F.filter(s["methods"], lambda m: F.array_contains(known, m)), lambda m: F.struct(m.alias("method"), (i + 1).alias("at"))
            ),
        )
    )

    def first(e: Column) -> Column:
        names = F.transform(e, lambda x: x["method"])
        return F.transform(
            F.array(names), lambda n: F.transform(F.array_distinct(n), lambda m: F.get(e, (F.array_position(n, m) - 1).cast("int")))
        )[0]

    return F.transform(F.array(every), first)[0]


def script_flows(corpus: DataFrame, all_sql_tables: bool = True, fallback: bool = False) -> DataFrame:
    """Reads, writes, flows and transformations of each script in ``corpus(script_path, source)``.

    ``all_sql_tables`` takes every table of a SQL read as a source; otherwise only the first.
    ``fallback`` links every read to every write of a script that has both but no flow with a source.
    Scripts are parsed where their splits lie; spread the keys of a corpus of few splits before its texts are read.
    """
    parsed = corpus.select("script_path", "source").mapInArrow(parse_scripts, SCRIPT_DDL)
    statements = F.col("statements")
    with_paths = (
        parsed.withColumn("known", _known_texts(statements))
        .withColumn("variables", _variables(statements, F.col("known")))
        .withColumn("statements", F.transform(statements, lambda s: s.withField("hits", _path_hits(s, F.col("known")))))
    )
    with_access = with_paths.withColumn(
        "statements",
        F.transform(
            statements,
            lambda s, i: F.struct(
                (i + 1).alias("at"),
                *[s[c].alias(c) for c in ("line", "target", "root_at", "used", "before", "methods")],
                _read(s, all_sql_tables).cast(ACCESS).alias("read"),
                _write(s).cast(ACCESS).alias("write"),
            ),
        ),
    )
    reads = F.flatten(
        F.transform(
            F.filter(statements, lambda s: s["read"].isNotNull()),
            lambda s: F.transform(
                s["read"]["paths"],
                lambda p: F.struct(p.alias("path"), s["read"]["format"].alias("format"), s["line"].alias("line")),
            ),
        )
    )
    writes = F.transform(
        F.filter(statements, lambda s: s["write"].isNotNull()),
        lambda s: F.struct(
            s["write"]["paths"][0].alias("path"), s["write"]["format"].alias("format"), s["line"].alias("line")
        ),
    )
    # a flow carries every transformation named before its write statement
    flows = F.transform(
        F.col("raw_flows"),
        lambda f: F.struct(
            f["line"].alias("line"),
            f["target"].alias("target"),
            F.array_sort(f["sources"]).alias("sources"),
            F.transform(F.filter("ops", lambda o: o["at"] < f["at"]), lambda o: o["method"]).alias("transformations"),
        ),
    )
    if fallback:
        crossed = F.transform(
            F.col("writes"),
            lambda w: F.struct(
                w["line"].alias("line"),
                w["path"].alias("target"),
                F.transform("reads", lambda r: r["path"]).alias("sources"),
                F.col("transformations").alias("transformations"),
            ),
        )
        linked = F.exists("raw_flows", lambda f: F.size(f["sources"]) > 0)
        flows = F.when(~linked & (F.size("reads") > 0), crossed).otherwise(flows)
    return (
        with_access.withColumn("ops", _first_ops(statements))
        .withColumn("held", _held_sources(statements))
        .withColumn("raw_flows", _flows(statements, F.col("held")))
        .withColumn("reads", _seen_once(reads))
        .withColumn("writes", _seen_once(writes))
        .withColumn("transformations", F.transform("ops", lambda o: o["method"]))
        .select(
            last_part(F.col("script_path")).alias("script"),
            "script_path",
            stage_of_script(F.col("script_path")).alias("layer"),
            "reads",
            "writes",
            flows.alias("flows"),
            "transformations",
            "variables",
            "error",
        )
    )


def scan_totals(scripts: DataFrame) -> DataFrame:
    """One row: scripts, reads, writes, flows, errors."""
    sizes = [F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("reads", "writes", "flows")]
    return scripts.agg(F.count(F.lit(1)).alias("scripts"), *sizes, F.count("error").alias("errors"))

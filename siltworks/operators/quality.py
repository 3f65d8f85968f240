"""Scores generated lineage against a known truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions.text import normal_id

# Grades of the overall score and marks of a single score, with their lower limits.
GRADES = [(95, "EXCELENTE"), (85, "MUY BUENO"), (70, "ACEPTABLE")]
LOWEST_GRADE = "NECESITA MEJORAS"
MARKS = [(100, "✔"), (80, "△")]
LOWEST_MARK = "✗"


def _sides(gen: DataFrame, truth: DataFrame, met: bool = False) -> DataFrame:
    """Distinct items with flags for both sides, in one shuffle with a combine before it.

    ``met`` leaves the combine out, for items that hardly repeat: it would hold all items that a task reads.
    """
    columns = gen.columns
    yes, no = F.lit(True), F.lit(False)
    both = gen.withColumn("in_gen", yes).withColumn("in_truth", no).unionByName(
        truth.select(columns).withColumn("in_gen", no).withColumn("in_truth", yes)
    )
    if met:
        both = both.repartition(*columns)
    return both.groupBy(*columns).agg(F.max("in_gen").alias("in_gen"), F.max("in_truth").alias("in_truth"))


def _percent(c: Column) -> Column:
    return F.bround(F.coalesce(c, F.lit(0.0)) * 100, 2)


def confusion(gen: DataFrame, truth: DataFrame, by: list[str], met: bool = False) -> DataFrame:
    """Counts, precision, recall and F1 per group; empty denominators give 0.

    All columns of both inputs other than ``by`` make up an item. Groups without truth are left out. ``met`` is for
    items that hardly repeat.
    """
    return _scored(_sides(gen, truth, met), by)


def _scored(sides: DataFrame, by: list[str]) -> DataFrame:
    g, t = F.col("in_gen"), F.col("in_truth")
    counted = sides.groupBy(*by).agg(
        F.count_if(t).alias("total_truth"),
        F.count_if(g).alias("total_generated"),
        F.count_if(g & t).alias("true_positives"),
        F.count_if(g & ~t).alias("false_positives"),
        F.count_if(t & ~g).alias("false_negatives"),
    )
    if by:
        counted = counted.filter(F.col("total_truth") > 0)
    tp = F.col("true_positives")
    p = F.coalesce(F.try_divide(tp, F.col("total_generated")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, F.col("total_truth")), F.lit(0.0))
    f1 = F.try_divide(2 * p * r, p + r)
    return counted.withColumns({"precision": _percent(p), "recall": _percent(r), "f1": _percent(f1)})


def outcomes(gen: DataFrame, truth: DataFrame, met: bool = False) -> DataFrame:
    """Every distinct item with its outcome: tp, fp or fn.

    Rows rather than one list per score, since a list would gather a whole graph in one task.
    """
    g, t = F.col("in_gen"), F.col("in_truth")
    label = F.when(g & t, "tp").when(g, "fp").otherwise("fn")
    sides = _sides(gen, truth, met)
    items = [c for c in sides.columns if c not in ("in_gen", "in_truth")]
    return sides.select(label.alias("outcome"), *items).orderBy("outcome", *items)


def edge_items(edges: DataFrame, *extra: str) -> DataFrame:
    """Edge ends in the form in which they are compared."""
    return edges.select(
        *extra, normal_id(F.col("source_id")).alias("source_id"), normal_id(F.col("target_id")).alias("target_id")
    )


def transform_items(edges: DataFrame) -> DataFrame:
    """(script, transform) of edges with a comma-separated transformation list."""
    some = edges.filter(F.col("transformations") != "")
    return some.select("script", F.explode(F.split("transformations", ",")).alias("transform")).withColumn(
        "transform", F.trim("transform")
    )


def edge_quality(gen: DataFrame, truth: DataFrame) -> DataFrame:
    return _scored(_sides(edge_items(gen), edge_items(truth), met=True), [])


def edge_outcomes(gen: DataFrame, truth: DataFrame) -> DataFrame:
    return outcomes(edge_items(gen), edge_items(truth), met=True)


def edge_quality_by_script(gen: DataFrame, truth: DataFrame) -> DataFrame:
    """Per script of the truth."""
    return _scored(_sides(edge_items(gen, "script"), edge_items(truth, "script"), met=True), ["script"])


def _edge_keys(edges: DataFrame) -> DataFrame:
    """(script, a, b, proof): 128 bits that stand for both ends of an edge, and 64 others that show if two edges share them."""
    ends = [F.isnull("source_id"), F.col("source_id"), F.isnull("target_id"), F.col("target_id")]
    keys = [F.xxhash64(F.lit(seed), *ends).alias(name) for seed, name in enumerate(("a", "b", "proof"))]
    return edge_items(edges, "script").select("script", *keys)


def edge_scores(gen: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edge_quality`` and ``edge_quality_by_script`` from one pass over the edges.

    Edges are compared by 128-bit keys, so that no long id is shuffled; every group of equal keys is checked by 64 further
    bits, and the query fails if they differ. The scores over all scripts roll up the rows by script: one shuffle by the
    key of an edge serves both, and no combine holds the edges before it.
    """

    def alike(sides: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
        flags = [F.max(c).alias(c) for c in ("in_gen", "in_truth")]
        found = sides.groupBy(*by, "a", "b").agg(*flags, F.min(low).alias("low"), F.max(high).alias("high"))
        clash = F.raise_error(F.lit("two edges have one key")).cast("boolean")
        return found.withColumn("in_gen", F.when(F.col("low") == F.col("high"), F.col("in_gen")).otherwise(clash))

    yes, no = F.lit(True), F.lit(False)
    both = _edge_keys(gen).withColumns({"in_gen": yes, "in_truth": no}).unionByName(_edge_keys(truth).withColumns({"in_gen": no, "in_truth": yes}))
    sides = alike(both.repartition("a", "b"), ["script"], "proof", "proof")
    return _scored(alike(sides, [], "low", "high"), []), _scored(sides, ["script"])


def transform_quality(gen: DataFrame, truth: DataFrame) -> DataFrame:
    """``gen`` are edges, ``truth`` is (script, transform)."""
    return confusion(transform_items(gen), truth.select("script", "transform"), ["script"])


def node_quality(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """Table names found per layer of the truth(layer, table_name)."""
    return confusion(nodes.select("layer", "table_name"), truth.select("layer", "table_name"), ["layer"], met=True)


def _ladder(score: Column, steps: list[tuple[int, str]], lowest: str) -> Column:
    result = F.lit(lowest)
    for limit, label in reversed(steps):
        result = F.when(score >= limit, label).otherwise(result)
    return result


def grade(score: Column) -> Column:
    return _ladder(score, GRADES, LOWEST_GRADE)


def mark(score: Column) -> Column:
    return _ladder(score, MARKS, LOWEST_MARK)


def overall_quality(edge: DataFrame, script: DataFrame, transform: DataFrame, node: DataFrame) -> DataFrame:
    """One row: mean F1 of each score, their mean, and the grade."""
    parts = {"edge_f1": edge, "script_f1": script, "transform_f1": transform, "node_f1": node}
    means = None
    for name, df in parts.items():
        # scores have two decimals: an exact sum does not depend on the order of the rows
        total = F.sum(F.col("f1").cast("decimal(9,2)")).cast("double")
        one = df.agg(F.try_divide(total, F.count("f1")).alias("f1")).select(
            *[(F.col("f1") if k == name else F.lit(None).cast("double")).alias(k) for k in parts]
        )
        means = one if means is None else means.unionByName(one)
    row = means.agg(*[F.coalesce(F.max(k), F.lit(0.0)).alias(k) for k in parts])
    mean = sum((F.col(k) for k in parts), F.lit(0.0)) / len(parts)
    return row.withColumn("overall", F.bround(mean, 2)).withColumn("grade", grade(mean))


REPORT = ["total_truth", "total_generated", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1"]


def quality_report(edge: DataFrame, script: DataFrame, transform: DataFrame, node: DataFrame) -> DataFrame:
    """All scores in one table: section, name, the counts and scores, and a mark or grade.

    Sections are overall, scripts, transforms, nodes and summary; the summary has the mean F1 of each section and the
    overall score. ``sources.sinks.write_report`` writes it as JSON lines.
    """
    parts = [("overall", "edges", edge), ("scripts", F.col("script"), script), ("transforms", F.col("script"), transform), ("nodes", F.col("layer"), node)]
    rows = [
        df.select(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), *REPORT, mark(F.col("f1")).alias("verdict"))
        for section, name, df in parts
    ]
    overall = overall_quality(edge, script, transform, node)
    scores = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("f1")) for n in ("edge_f1", "script_f1", "transform_f1", "node_f1", "overall")))
    summary = overall.select("grade", F.explode(scores).alias("s")).select("s.*", F.when(F.col("s.name") == "overall", F.col("grade")).otherwise(mark(F.col("s.f1"))).alias("verdict"))
    missing = [F.lit(None).cast("double" if c in ("precision", "recall") else "bigint").alias(c) for c in REPORT[:-1]]
    rows.append(summary.select(F.lit("summary").alias("section"), "name", *missing, "f1", "verdict"))
    return reduce(DataFrame.unionByName, rows)

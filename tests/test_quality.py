import pytest
from pyspark.sql import functions as F

from siltworks.operators import quality

EDGES = "source_id string, target_id string, script string, transformations string"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], EDGES)


def score(df):
    return tuple(df.first())


def test_edges_are_compared_in_normal_form(spark, rows):
    gen = edges(spark, ("S3A://a/", "b"), ("s3a://a", " B/ "), ("x", "y"))
    truth = edges(spark, ("s3a://a", "b"), ("p", "q"))
    assert score(quality.edge_quality(gen, truth)) == (2, 2, 1, 1, 1, 50.0, 50.0, 50.0)
    assert rows(quality.edge_outcomes(gen, truth)) == [("fn", "p", "q"), ("fp", "x", "y"), ("tp", "s3a://a", "b")]


@pytest.mark.parametrize(
    "gen, truth, want",
    [
        ([], [], (0, 0, 0, 0, 0, 0.0, 0.0, 0.0)),
        ([("a", "b")], [], (0, 1, 0, 1, 0, 0.0, 0.0, 0.0)),
        ([], [("a", "b")], (1, 0, 0, 0, 1, 0.0, 0.0, 0.0)),
        ([("a", "b")], [("a", "b")], (1, 1, 1, 0, 0, 100.0, 100.0, 100.0)),
        ([("a", "b"), ("c", "d"), ("e", "f")], [("a", "b")], (1, 3, 1, 2, 0, 33.33, 100.0, 50.0)),
    ],
)
def test_empty_and_perfect_sets(spark, gen, truth, want):
    assert score(quality.edge_quality(edges(spark, *gen), edges(spark, *truth))) == want


def test_only_scripts_of_the_truth_are_scored(spark, rows):
    gen = edges(spark, ("a", "b", "one.py"), ("a", "c", "two.py"), ("a", "d", "three.py"))
    truth = edges(spark, ("a", "b", "one.py"), ("z", "c", "two.py"), ("q", "q", "lost.py"))
    assert rows(quality.edge_quality_by_script(gen, truth), "script", "f1") == [("lost.py", 0.0), ("one.py", 100.0), ("two.py", 0.0)]


def test_transform_lists_are_split_and_trimmed(spark, rows):
    gen = edges(spark, ("a", "b", "x.py", "select, join"), ("a", "c", "x.py", "join,agg"), ("a", "d", "x.py", ""), ("a", "d", "y.py", None))
    truth = spark.createDataFrame([("x.py", "join"), ("x.py", "trim"), ("y.py", "join")], "script string, transform string")
    assert rows(quality.transform_quality(gen, truth), "script", "true_positives", "precision", "recall", "f1") == [
        ("x.py", 1, 33.33, 50.0, 40.0), ("y.py", 0, 0.0, 0.0, 0.0),
    ]


def test_grades_and_marks(spark):
    df = spark.createDataFrame([(v,) for v in (100.0, 95.0, 94.99, 85.0, 70.0, 69.99)], "v double")
    got = [tuple(r) for r in df.select(quality.grade(F.col("v")), quality.mark(F.col("v"))).collect()]
    assert got == [
        ("EXCELENTE", "✔"), ("EXCELENTE", "△"), ("MUY BUENO", "△"), ("MUY BUENO", "△"), ("ACEPTABLE", "✗"), ("NECESITA MEJORAS", "✗"),
    ]


def test_overall_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "f1 double")
    one = spark.createDataFrame([(80.0,), (90.0,)], "f1 double")
    assert tuple(quality.overall_quality(one, none, none, none).first()) == (85.0, 0.0, 0.0, 0.0, 21.25, "NECESITA MEJORAS")


def test_outcomes_are_ordered(spark):
    one = "source_id string, target_id string"
    gen = spark.createDataFrame([("c", "d"), ("a", "b"), ("x", "y")], one).repartition(3)
    truth = spark.createDataFrame([("a", "b"), ("m", "n"), ("c", "d")], one).repartition(3)
    got = [tuple(r) for r in quality.outcomes(gen, truth).collect()]
    assert got == [("fn", "m", "n"), ("fp", "x", "y"), ("tp", "a", "b"), ("tp", "c", "d")]


def test_one_pass_scores_are_the_separate_ones(spark):
    cols = "script string, source_id string, target_id string"
    gen = spark.createDataFrame([("a", "s3a://x/", "Y"), ("b", "s3a://x", "y"), ("b", "p", "q"), ("c", "o", "o2")], cols)
    truth = spark.createDataFrame([("a", "s3a://x", "y"), ("b", "p", "r"), ("d", "k", "l")], cols)
    edge, script = quality.edge_scores(gen, truth)
    assert edge.collect() == quality.edge_quality(gen, truth).collect()
    assert sorted(script.collect()) == sorted(quality.edge_quality_by_script(gen, truth).collect())


def test_edge_items_are_not_held_before_they_meet(spark):
    edges = spark.createDataFrame([("a", "b", "s"), ("a", "b", "s"), (None, "c", "s"), ("x", "y", None)], "source_id string, target_id string, script string")
    for made, n in ((quality.edge_outcomes(edges, edges.limit(1)), 3), (quality.edge_quality(edges, edges), 1), (quality.edge_quality_by_script(edges, edges), 2)):
        assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == n


def test_edges_are_shuffled_once_for_both_scores(spark):
    edges = spark.createDataFrame([("a", "b", "j.py"), ("a", "b", "k.py"), ("B/", "c", "j.py")], "source_id string, target_id string, script string")
    whole, by_script = quality.edge_scores(edges, edges.limit(2))
    for scores, shuffles in ((whole, 1), (by_script, 2)):
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == shuffles  # scores by script are gathered by script
    assert [(r.total_truth, r.total_generated, r.true_positives) for r in whole.collect()] == [(1, 2, 1)]
    assert sorted((r.script, r.total_generated) for r in by_script.collect()) == [("j.py", 2), ("k.py", 1)]


def test_names_of_nodes_meet_without_a_combine(spark):
    nodes = spark.createDataFrame([("bronze", "t1"), ("bronze", "t2"), ("gold", "t1")], "layer string, table_name string")
    plan = quality.node_quality(nodes, nodes)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(") :]
    assert "HashAggregate" not in below and "REPARTITION" in below.upper()

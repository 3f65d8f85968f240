import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import lineage

NODE = "node_id string, node_type string, layer string, database string, table_name string, full_name string, location string, format string, row_count bigint, column_count bigint, columns_json string, scanned_at string"
EDGE = "source_id string, target_id string, script string, dag_id string, layer string, transformations string"


def nodes(spark, *ids):
    data = [(i, "hive_table", "silver", "silver", i, f"silver.{i}", "", "parquet", 1, 1, '[{"name":"a","type":"int"}]', "") for i in ids]
    return spark.createDataFrame(data, NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([(s, t, "x.py", "", "unknown", "") for s, t in pairs], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def hops(result):
    return {(r["seed_id"], r["node_id"]): r["hop"] for r in result.collect()}


def crossed(result):
    return sorted((r["seed_id"], r["source_id"], r["target_id"]) for r in result.collect())


def brute(pairs, start, depth):
    """Shortest distance by plain breadth-first search, and the edges leaving every node closer than depth."""
    seen, frontier = {start: 0}, [start]
    for hop in range(1, depth):
        frontier = sorted({t for s, t in pairs if s in frontier} - set(seen))
        seen |= dict.fromkeys(frontier, hop)
    return seen, sorted({(start, s, t) for s, t in pairs if s in seen})


def test_depth_counts_edges_and_ends_before_the_last_node(spark):
    chain = [("a", "b"), ("b", "c"), ("c", "d")]
    found, links = lineage.downstream(nodes(spark, *"abcd"), edges(spark, *chain), seeds(spark, "a"), 2)
    assert hops(found) == {("a", "a"): 0, ("a", "b"): 1}
    assert crossed(links) == [("a", "a", "b"), ("a", "b", "c")]
    found, links = lineage.downstream(nodes(spark, *"abcd"), edges(spark, *chain), seeds(spark, "a"), 1)
    assert (hops(found), crossed(links)) == ({("a", "a"): 0}, [("a", "a", "b")])


def test_cycles_end_and_the_shortest_way_counts(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d")]
    found, links = lineage.downstream(nodes(spark, *"abcd"), edges(spark, *pairs, ("a", "b")), seeds(spark, "a"), 10)
    assert hops(found) == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}
    assert crossed(links) == sorted(("a", *p) for p in pairs)


def test_unknown_nodes_are_passed_but_not_listed(spark):
    found, links = lineage.upstream(nodes(spark, "a", "c"), edges(spark, ("a", "b"), ("b", "c")), seeds(spark, "c", "gone"), 3)
    assert hops(found) == {("c", "c"): 0, ("c", "a"): 2}
    assert crossed(links) == [("c", "a", "b"), ("c", "b", "c")]


@pytest.mark.parametrize("depth", [0, 11])
def test_depth_is_limited(spark, depth):
    with pytest.raises(ValueError):
        lineage.upstream(nodes(spark, "a"), edges(spark, ("a", "b")), seeds(spark, "a"), depth)


@pytest.mark.parametrize("small", [True, False])
def test_random_graph_with_a_hub_against_brute_force(spark, small, request):
    if not small:
        request.getfixturevalue("unbroadcast")
    rng = random.Random(7)
    names = [f"n{i}" for i in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    pairs += [("n0", n) for n in names] + [(n, "n0") for n in names[:20]]  # a hub on a good half of the edges
    pairs += pairs[:30]
    starts = names[::4]
    found, links = lineage.downstream(nodes(spark, *names), edges(spark, *pairs), seeds(spark, *starts), 3)
    want_hops, want_links = {}, []
    for s in starts:
        seen, out = brute(pairs, s, 3)
        want_hops |= {(s, n): h for n, h in seen.items()}
        want_links += out
    assert hops(found) == want_hops
    assert crossed(links) == sorted(want_links)
    turned = edges(spark, *[(t, s) for s, t in pairs])
    back, _ = lineage.upstream(nodes(spark, *names), turned, seeds(spark, *starts), 3)
    assert hops(back) == want_hops


def test_search_wildcards_case_and_limit(spark):
    n = nodes(spark, "Sales_1", "SALESx1", "other", "back\\slash")
    assert [r["node_id"] for r in lineage.search(n, "es_1").collect()] == ["SALESx1", "Sales_1"]
    assert [r["node_id"] for r in lineage.search(n, "k\\s").collect()] == ["back\\slash"]
    assert lineage.search(n, "%", n=2).count() == 2
    with pytest.raises(ValueError):
        lineage.search(n, "")


def test_detail_degrees_and_broken_columns(spark):
    n = nodes(spark, "a", "b", "c").withColumn(
        "columns_json", F.when(F.col("node_id") == "b", "{oops").otherwise(F.col("columns_json"))
    )
    e = edges(spark, ("a", "b"), ("a", "b"), ("c", "b"))
    got = {r["node_id"]: r for r in lineage.node_detail(n, e, seeds(spark, "a", "b", "gone")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["b"]["upstream_count"], got["b"]["downstream_count"], got["b"]["columns"]) == (3, 0, [])
    assert (got["a"]["upstream_count"], got["a"]["downstream_count"]) == (0, 2)
    assert [tuple(c) for c in got["a"]["columns"]] == [("a", "int")]


def test_stats_lists_and_subgraph(spark):
    n, e = nodes(spark, "a", "b"), edges(spark, ("a", "b"))
    totals, by_node, by_edge = lineage.stats(n, e)
    assert tuple(totals.first()) == (2, 1)
    assert [tuple(r) for r in by_node.collect()] == [("silver", 2)] and [tuple(r) for r in by_edge.collect()] == [("unknown", 1)]
    assert [x.count() for x in lineage.subgraph(n, e, "silver")] == [2, 0]
    assert [x.count() for x in lineage.subgraph(n, e, "silver", "unknown")] == [2, 1]
    assert lineage.list_edges(e, dag_id="none").count() == 0 and lineage.list_nodes(n).count() == 2


def test_lists_are_ordered(spark):
    data = [("gold", "b", "2"), ("bronze", "z", "1"), ("gold", "a", "9"), ("gold", "b", "1"), ("silver", "m", "5")]
    n = spark.createDataFrame([(i, "hive_table", layer, layer, name, name, "", "parquet", 1, 1, "[]", "") for layer, name, i in data], NODE)
    assert [(r["layer"], r["table_name"], r["node_id"]) for r in lineage.list_nodes(n.repartition(3)).collect()] == sorted(data)
    rows = [("s2", "t1", "x.py", "d2", "b", ""), ("s1", "t2", "x.py", "d1", "b", ""), ("s1", "t1", "x.py", "d1", "b", ""), ("s9", "t9", "x.py", "d9", "a", "")]
    e = spark.createDataFrame(rows, EDGE).repartition(3)
    got = [(r["layer"], r["dag_id"], r["source_id"], r["target_id"]) for r in lineage.list_edges(e).collect()]
    assert got == sorted((r[4], r[3], r[0], r[1]) for r in rows)


def test_seeds_are_named_before_rows_get_wide(spark, unbroadcast, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "t", "l", f"n{i}", f"n{i}", "p", 1, 1, "", "") for i in range(6)], "node_id string, node_type string, layer string, table_name string, full_name string, format string, row_count bigint, column_count bigint, scanned_at string, location string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "s", "d", "l", "x") for i in range(5)] * 2, "source_id string, target_id string, script string, dag_id string, layer string, transformations string")
    moved = []
    plain = lineage.skew_join
    monkeypatch.setattr(lineage, "skew_join", lambda left, right, key, *a, **k: moved.append((key, left.columns)) or plain(left, right, key, *a, **k))
    found, crossed = lineage.downstream(nodes, edges, spark.createDataFrame([("n0",), ("n3",)], "node_id string"))
    assert sorted((r.seed_id, r.node_id, r.hop) for r in found.collect()) == [("n0", "n0", 0), ("n0", "n1", 1), ("n0", "n2", 2), ("n3", "n3", 0), ("n3", "n4", 1), ("n3", "n5", 2)]
    assert sorted((r.seed_id, r.source_id) for r in crossed.collect()) == [("n0", "n0"), ("n0", "n1"), ("n0", "n2"), ("n3", "n3"), ("n3", "n4")]
    assert all(set(columns) <= {"seed", "id", "hop"} for key, columns in moved if key == "seed")

import re
import time

import pytest
from pyspark.sql import functions as F

from siltworks.operators import adjacency, lineage
from siltworks.operators.adjacency import graph_store
from siltworks.samples.registry import QUERIES
from siltworks.sources import scratch
from siltworks.sources.scratch import cut
from test_lineage import brute, crossed, edges, hops, nodes, seeds


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hop_moves_no_edge(spark, shuffled, unbroadcast):
    names = [f"n{k}" for k in range(50)]
    pairs = [(names[k % 50], names[(k * 7 + 1) % 50]) for k in range(400)]
    store = graph_store(nodes(spark, *names), edges(spark, *pairs), list(adjacency.NUMBERS))
    at = cut(store.names.df.select(F.col("id").alias("seed"), "id"), "at")
    for near, far in (("source_id", "target"), ("target_id", "source")):
        text = plan(store.met(at, near, far))
        # one shuffle: of the frontier; the edges come from their buckets as they lie
        assert text.count("Exchange hashpartitioning") == 1, text
        assert re.search(r"Bucketed: true", text), text
        scans = [part for part in re.split(r"\n", text) if "FileScan" in part]
        assert len(scans) == 2 and not any("script" in s for s in scans)  # two numbers of an edge are read
        assert "SelectedBucketsCount" in next(s for s in scans if "lane" in s)


def test_hub_edges_lie_in_many_buckets(spark, shuffled, unbroadcast):
    pairs = [("hub", f"n{k}") for k in range(600)] + [(f"n{k}", f"m{k}") for k in range(600)]
    store = graph_store(nodes(spark, "hub"), edges(spark, *pairs, *pairs[:50]), ["source_id"])
    assert [n for n, _ in store.hot["source_id"]] == [r.id for r in store.names.df.filter("node_id = 'hub'").collect()]
    per_file = store.edges["source_id"].groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per_file) == 1200 and max(r["count"] for r in per_file) < 600
    found, links = lineage.downstream(nodes(spark, "hub", *[f"n{k}" for k in range(600)]), edges(spark, *pairs), seeds(spark, "hub"), 2, store)
    want, out = brute(pairs, "hub", 2)
    assert hops(found) == {("hub", n): h for n, h in want.items()} and crossed(links) == out


def test_a_node_that_all_seeds_reach(spark, unbroadcast):
    """Frequent in the frontier, not in the edges."""
    pairs = [(f"s{k}", "mid") for k in range(300)] + [("mid", "end"), ("end", "last")]
    starts = [f"s{k}" for k in range(300)]
    found, _ = lineage.downstream(nodes(spark, "mid", "end", "last"), edges(spark, *pairs), seeds(spark, *starts), 4)
    assert hops(found) == {(s, n): h for s in starts for n, h in (("mid", 1), ("end", 2), ("last", 3))}


def test_nodes_that_share_a_number(spark, monkeypatch, request):
    monkeypatch.setattr(adjacency, "node_number", lambda c: F.when(c.isNotNull(), F.pmod(F.length(c), F.lit(2)).cast("bigint")))
    names = [f"{'x' * (k % 3)}n{k}" for k in range(12)]
    pairs = [(names[k], names[(5 * k + 2) % 12]) for k in range(12)] + [(names[0], names[9])]
    want, out = brute(pairs, names[0], 4)
    for small in (True, False):
        if not small:
            monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
        found, links = lineage.downstream(nodes(spark, *names), edges(spark, *pairs), seeds(spark, names[0], "unknown"), 4)
        assert hops(found) == {(names[0], n): h for n, h in want.items()} and crossed(links) == out


def test_null_ends_and_an_empty_graph(spark):
    made = edges(spark, ("a", "b")).union(spark.createDataFrame([("a", None, "x", "", "", ""), (None, "b", "x", "", "", "")], lineage_schema()))
    found, links = lineage.downstream(nodes(spark, "a", "b"), made, seeds(spark, "a"), 3)
    assert hops(found) == {("a", "a"): 0, ("a", "b"): 1}
    assert sorted((r.source_id, r.target_id or "") for r in links.collect()) == [("a", ""), ("a", "b")]
    none = edges(spark, ("a", "b")).limit(0)
    found, links = lineage.upstream(nodes(spark, "a"), none, seeds(spark, "a"), 3)
    assert hops(found) == {("a", "a"): 0} and links.count() == 0


def lineage_schema():
    return "source_id string, target_id string, script string, dag_id string, layer string, transformations string"


def folders(path):
    """Kinds of the tables that lie in the shared folder."""
    at = path / "siltworks"
    return sorted({re.sub(r"-[0-9a-f]{32}$", "", f.name) for f in at.iterdir()}) if at.exists() else []


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def test_edges_are_shuffled_once_to_their_buckets(spark, unbroadcast, monkeypatch):
    seen, write = [], adjacency.bucketed
    monkeypatch.setattr(adjacency, "bucketed", lambda df, *a: seen.append(plan(df)) or write(df, *a))
    names = [f"n{k}" for k in range(40)]
    pairs = [(names[k % 40], names[(k * 7 + 1) % 40]) for k in range(200)]
    store = graph_store(nodes(spark, *names), edges(spark, *pairs), ["source_id"])
    assert not store.hot["source_id"] and seen[0].count("Exchange") == 1, seen[0]
    files = store.edges["source_id"].select(F.input_file_name().alias("f"), "source").distinct().groupBy("source").count()
    assert {r["count"] for r in files.collect()} == {1}
    assert store.edges["source_id"].count() == len(set(pairs))


def test_a_question_leaves_no_more_than_its_answer_reads(spark, unbroadcast, shared):
    names = [f"n{k}" for k in range(12)]
    pairs = [(names[k], names[(5 * k + 2) % 12]) for k in range(12)] + [(names[0], names[9])]
    want, out = {}, []
    for s in names[:2]:
        seen, links = brute(pairs, s, 4)
        want, out = want | {(s, n): h for n, h in seen.items()}, sorted(out + links)

    def shuffles():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")

    before = shuffles()
    found, links = lineage.downstream(nodes(spark, *names), edges(spark, *pairs), seeds(spark, names[0], names[1]), 4)
    left = time.monotonic() + 20
    while shuffles() > before and time.monotonic() < left:
        time.sleep(0.2)
    assert shuffles() <= before
    assert set(folders(shared)) - {"edges-of-frequent"} == {"edges_by_end", "reached"}
    assert hops(found) == want and crossed(links) == out
    assert crossed(links) == out  # a second time
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_store_that_is_handed_in_stays(spark, unbroadcast):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")]
    store = graph_store(nodes(spark, *"abcd"), edges(spark, *pairs))
    _, links = lineage.downstream(nodes(spark, *"abcd"), edges(spark, *pairs), seeds(spark, "a"), 2, store)
    assert crossed(links) == [("a", "a", "b"), ("a", "b", "c")]
    found, links = lineage.upstream(nodes(spark, *"abcd"), edges(spark, *pairs), seeds(spark, "d"), 2, store)
    assert hops(found) == {("d", "d"): 0, ("d", "c"): 1} and crossed(links) == [("d", "b", "c"), ("d", "c", "d")]


def test_a_query_for_nodes_stores_no_attribute_of_an_edge(spark, unbroadcast, shared, tmp_path_factory, monkeypatch):
    sf = tmp_path_factory.mktemp("tables")
    tables = {
        "part": ("p_partkey bigint", [(1,), (2,)]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(1, 5), (2, 6)]),
        "customer": ("c_custkey bigint, c_nationkey bigint", [(5, 3), (6, 3)]),
        "nation": ("n_nationkey bigint, n_regionkey bigint", [(3, 1)]),
        "region": ("r_regionkey bigint", [(1,)]),
        "lineitem": ("l_partkey bigint, l_orderkey bigint", [(1, 1), (1, 2), (1, 2), (2, 2)]),
    }
    for name, (kind, data) in tables.items():
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    stored = []
    for module in (adjacency, lineage):
        monkeypatch.setattr(module, "cut", lambda df, label, plain=module.cut: stored.append((label, df.columns)) or plain(df, label))
    write = adjacency.bucketed
    monkeypatch.setattr(adjacency, "bucketed", lambda df, *a: stored.append(("edges_by_end", df.columns)) or write(df, *a))
    found = QUERIES["downstream_nodes"](spark, str(sf))
    assert sorted(dict(stored)["edges_by_end"]) == ["lane", "source", "target"]
    assert not [label for label, columns in stored if {"script", "dag_id", "layer", "transformations"} & set(columns)]
    assert folders(shared) == ["reached"]
    got = sorted((r.seed_id[-1], r.node_id.split(".")[1], r.hop) for r in found.collect())
    first = [("1", "customer_5", 2), ("1", "customer_6", 2), ("1", "order_1", 1), ("1", "order_2", 1), ("1", "part_1", 0)]
    assert got == [*first, ("2", "customer_6", 2), ("2", "order_2", 1), ("2", "part_2", 0)]

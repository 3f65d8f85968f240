"""Makes a raw graph presentable: one node per name, resolved edges, one edge per job or script."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.functions.text import display_id, first_swap, job_label, short_name
from siltworks.operators.skew import hot_among, skew_join
from siltworks.sources.scratch import Stored, cut

# Layers that are shown, in order.
SHOWN = ["bronze", "silver", "gold", "unknown"]


def _keyed(nodes: DataFrame) -> DataFrame:
    key = F.concat(F.coalesce("layer", F.lit("null")), F.lit("|"), short_name(F.col("node_id")))
    return nodes.withColumn("name_key", key)


def _winners(keyed: DataFrame) -> DataFrame:
    """Per (layer, short name): the node that stands for all, and where the group is first seen.

    Nodes are taken in (layer, table name, id) order. The last catalog table wins; without one the
    first node does. Both are plain min/max aggregates, so a name shared by a third of all nodes
    is combined before the shuffle.
    """
    order = [F.col("table_name"), F.col("node_id")]
    row = F.struct(*order, *[F.col(c) for c in keyed.columns if c not in ("table_name", "node_id", "name_key")])
    is_table = F.col("node_type") == "hive_table"
    return keyed.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.max(F.when(is_table, row)), F.min(row)).alias("winner"),
        F.min(F.struct(*order)).alias("first_seen"),
    )


def _canonical_map(keyed: DataFrame, winners: Stored, *columns: str) -> DataFrame:
    """Every node with ``columns`` of its group's row in ``winners(name_key, members, ...)``.

    The groups were counted when they were made, so that hot names need no search.
    """
    named = winners.select("name_key", *columns)
    hot = [] if named.small else hot_among(winners.df, "name_key", "members")
    return skew_join(keyed.select("node_id", "name_key"), named, "name_key", "left", hot_left=hot).drop("name_key")


def canonical_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that stay, and ``(node_id, canonical_id)`` for every node. Starts a job."""
    keyed = _keyed(nodes)
    winners = _winners(keyed)
    few = _winners(keyed.select("node_id", "node_type", "table_name", "name_key"))
    named = cut(few.select("name_key", "members", F.col("winner.node_id").alias("canonical_id")), "name-winners")
    return winners.select("winner.*").select(nodes.columns), _canonical_map(keyed, named, "canonical_id")


def _endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, shown_id) for every edge end that can be shown.

    Tried in order: the canonical node, the id itself, the short name among the shown nodes. Most
    ends settle with the canonical node; only the others enter the lookup by id and name.
    """
    keyed = _keyed(nodes.select("node_id", "node_type", "layer", "table_name"))
    layer = F.coalesce(F.nullif("winner.layer", F.lit("")), F.lit("unknown"))
    rank = F.array_position(F.array(*[F.lit(x) for x in SHOWN]), layer).cast("int")
    winners = cut(
        _winners(keyed).select(
            "name_key",
            "members",
            F.col("winner.node_id").alias("canonical_id"),
            F.col("winner.table_name").alias("table_name"),
            rank.alias("rank"),
            F.col("first_seen.table_name").alias("first_name"),
            F.col("first_seen.node_id").alias("first_id"),
        ),
        "name-winners",
    )
    shown = winners.df.filter(F.col("rank") > 0).withColumn("shown_id", display_id(F.col("canonical_id")))
    by_name = (
        shown.filter(F.col("table_name") != "")
        .groupBy(F.concat(F.lit("name "), "table_name").alias("wanted"))
        .agg(F.min_by("shown_id", F.struct("rank", "first_name", "first_id")).alias("shown_id"))
    )
    by_id = shown.select(F.concat(F.lit("id "), "shown_id").alias("wanted"), "shown_id").distinct()

    settled = F.when(F.col("rank") > 0, display_id(F.col("canonical_id")))
    ends = cut(
        edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
        .filter(F.col("node_id").isNotNull())
        .distinct()
        .join(_canonical_map(keyed, winners, "canonical_id", "rank"), "node_id", "left")
        .select("node_id", "canonical_id", settled.alias("shown_id")),
        "edge-ends",
    ).df
    node_id = F.col("node_id")
    wanted = [
        F.concat(F.lit("id "), display_id(F.col("canonical_id"))),
        F.concat(F.lit("id "), display_id(node_id)),
        F.concat(F.lit("name "), short_name(node_id)),
    ]
    tries = ends.filter(F.col("shown_id").isNull()).select("node_id", F.posexplode(F.array(*wanted)).alias("way", "wanted"))
    found = skew_join(tries.filter(F.col("wanted").isNotNull()), by_id.unionByName(by_name), "wanted")
    late = found.groupBy("node_id").agg(F.min_by("shown_id", "way").alias("shown_id"))
    return ends.filter(F.col("shown_id").isNotNull()).select("node_id", "shown_id").unionByName(late)


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between shown nodes; ends that cannot be resolved and self loops are dropped.

    Ends are resolved once per distinct id, not once per edge; the distinct edges are stored once. Starts jobs.
    """
    names = ["source_id", "target_id", "script", "dag_id", "layer", "transformations"]
    found = edges = cut(edges.select(names).distinct(), "edges").df
    shown = cut(_endpoints(nodes, edges), "shown-ends")
    for end, name in (("source_id", "source"), ("target_id", "target")):
        renamed = shown.renamed({"node_id": end, "shown_id": name})
        found = skew_join(found, renamed, end, left_keys=edges.select(end))
    return found.filter(F.col("source") != F.col("target")).select("source", "target", *names)


def typed_edges(resolved: DataFrame) -> DataFrame:
    """A job edge per (source, target, job) and a script edge per (source, target, script).

    Of several edges the first in (layer, job) order supplies the remaining columns.
    """
    kinds = F.array(
        F.struct(F.lit("dag").alias("edge_type"), F.col("dag_id").alias("name")),
        F.struct(F.lit("script").alias("edge_type"), F.col("script").alias("name")),
    )
    exploded = resolved.withColumn("k", F.explode(kinds)).filter(F.col("k.name") != "")
    first = F.min(F.struct("layer", "dag_id", "source_id", "target_id", "script", "transformations"))
    name = F.col("name")
    label = F.when(F.col("edge_type") == "dag", job_label(name)).otherwise(first_swap(name, ".py", ""))
    return (
        exploded.groupBy("k.edge_type", "source", "target", "k.name")
        .agg(first.alias("e"))
        .select("edge_type", "source", "target", "name", label.alias("label"), "e.*")
    )

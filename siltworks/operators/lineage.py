"""Questions asked of the lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.operators.adjacency import EDGE, NUMBERS, OTHER, GraphStore, graph_store
from siltworks.operators.skew import hot_keys, skew_join
from siltworks.sources.scratch import Stored, cut, discard, freed_shuffles

SUMMARY = ["node_id", "node_type", "layer", "table_name", "full_name", "format", "row_count", "column_count", "scanned_at"]
MAX_DEPTH = 10


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of nodes and edges."""
    zero = F.lit(0).cast("bigint")
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes")).withColumn("total_edges", zero)
    e = edges.agg(F.count(F.lit(1)).alias("total_edges")).withColumn("total_nodes", zero)
    return n.unionByName(e).agg(F.sum("total_nodes").alias("total_nodes"), F.sum("total_edges").alias("total_edges"))


def count_by_layer(df: DataFrame) -> DataFrame:
    return df.groupBy("layer").agg(F.count(F.lit(1)).alias("total")).orderBy("layer")


def stats(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals, nodes by layer, edges by layer."""
    return totals(nodes, edges), count_by_layer(nodes), count_by_layer(edges)


def search(nodes: DataFrame, term: str, n: int = 20) -> DataFrame:
    """First ``n`` nodes whose id or table name holds the term; case does not matter.

    ``%`` and ``_`` in the term match as wildcards.
    """
    if not term:
        raise ValueError("the search term needs at least one character")
    pattern = "%" + term.lower().replace("\\", "\\\\") + "%"
    return (
        nodes.filter(F.lower("node_id").like(pattern) | F.lower("table_name").like(pattern))
        .select("node_id", "node_type", "layer", "table_name", "full_name", "format")
        .orderBy("layer", "table_name", "node_id")
        .limit(n)
    )


def list_nodes(nodes: DataFrame, layer: str | None = None) -> DataFrame:
    """Node summaries, of one layer if given, by layer and name."""
    found = nodes.filter(F.col("layer") == layer) if layer else nodes
    counts = {c: F.col(c).cast("bigint") for c in ("row_count", "column_count")}
    return found.select(SUMMARY).withColumns(counts).orderBy("layer", "table_name", "node_id")


def filter_edges(edges: DataFrame, layer: str | None = None, dag_id: str | None = None) -> DataFrame:
    if layer:
        edges = edges.filter(F.col("layer") == layer)
    if dag_id:
        edges = edges.filter(F.col("dag_id") == dag_id)
    return edges


def list_edges(edges: DataFrame, layer: str | None = None, dag_id: str | None = None) -> DataFrame:
    """Edges of a layer and/or job, by layer and job."""
    return filter_edges(edges, layer, dag_id).select(EDGE).orderBy("layer", "dag_id", "source_id", "target_id")


def subgraph(
    nodes: DataFrame, edges: DataFrame, layer: str | None = None, edge_layer: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a layer.

    Nodes and edges use different layer names, so without ``edge_layer`` a node layer finds no edges.
    """
    return list_nodes(nodes, layer), list_edges(edges, edge_layer or layer)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges into and out of every node that has any; one shuffle of per-node partial counts."""
    ends = F.explode(
        F.array(
            F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )
    )
    return (
        edges.select(ends.alias("e"))
        .groupBy("e.node_id")
        .agg(F.sum("e.up").alias("upstream_count"), F.sum("e.down").alias("downstream_count"))
    )


def node_detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """All attributes, parsed columns and edge counts of the nodes in ``ids(node_id)``.

    A column list that cannot be parsed comes out empty; unknown ids give no row.
    """
    wanted = ids.select("node_id")
    counts = degrees(edges).join(wanted, "node_id", "left_semi")
    parsed = F.from_json("columns_json", "array<struct<name:string,type:string>>")
    none = F.array().cast("array<struct<name:string,type:string>>")
    return (
        nodes.join(wanted, "node_id", "left_semi")
        .join(counts, "node_id", "left")
        .withColumn("columns", F.coalesce(parsed, none))
        .drop("columns_json")
        .withColumns(
            {
                **{c: F.col(c).cast("bigint") for c in ("row_count", "column_count")},
                **{c: F.coalesce(c, F.lit(0)) for c in ("upstream_count", "downstream_count")},
            }
        )
    )


def _reach(store: GraphStore, seeds: DataFrame, depth: int, near: str) -> Stored:
    """(seed, id, hop), by number: everything at least hop ``0 .. depth-1`` away, by shortest way.

    One step joins the whole frontier of all seeds to the edges. Every frontier is written to the
    shared folder, so no plan grows with the depth and a lost executor costs one step. No step moves an edge
    (see ``GraphStore.met``); what is shuffled are pairs of numbers.
    """
    frontier = cut(seeds.select("seed", "id"), "frontier")
    visited = frontier.df.withColumn("hop", F.lit(0))
    rows, size, paths = frontier.rows, frontier.bytes, frontier.paths
    next_one = NUMBERS[OTHER[near]]
    for hop in range(1, depth):
        kept = len(store.apart)
        met = store.met(frontier, near, next_one, once=False).filter(F.col(next_one).isNotNull())
        step = met.select("seed", F.col(next_one).alias("id")).distinct()
        frontier = cut(step.join(visited, ["seed", "id"], "left_anti"), "frontier")
        paths += frontier.paths
        discard(seeds.sparkSession, store.apart[kept:])
        del store.apart[kept:]
        if frontier.rows == 0:
            break
        rows, size = rows + frontier.rows, size + frontier.bytes
        visited = visited.unionByName(frontier.df.withColumn("hop", F.lit(hop)))
    return Stored(visited, rows, size, paths=paths)


def _traverse(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, near: str, store: GraphStore | None, crossed: bool
) -> tuple[DataFrame, DataFrame | None]:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    with freed_shuffles(edges.sparkSession):
        found, links = _answers(nodes, edges, seeds, depth, near, store, crossed)
    found = found.select("seed_id", "node_id", "hop", *SUMMARY[1:-1], "location")
    return found, links.select("seed_id", *EDGE) if crossed else None


def _answers(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, near: str, store: GraphStore | None, crossed: bool
) -> tuple[DataFrame, DataFrame | None]:
    own = store is None
    if own:
        store = graph_store(nodes, edges, columns=EDGE if crossed else (), only=near)
    # only known ids: an unknown one reaches nothing, and its number could be another node's
    known = store.names.df.select("id", "node_id").join(seeds.select("node_id").distinct(), "node_id")
    # seeds have short numbers of their own: every pair of a frontier has one
    start = cut(known.select(F.monotonically_increasing_id().alias("seed"), "id", F.col("node_id").alias("seed_id")), "seeds")
    reached = _reach(store, start.df, depth, near)
    attributes = store.numbered(nodes.select(*SUMMARY[:-1], "location"), "node_id", "id")
    seed_names = start.select("seed", "seed_id")
    links = None
    if reached.small:  # measured
        found = skew_join(attributes.join(F.broadcast(reached.df), "id"), seed_names, "seed", left_keys=reached.df)
        if crossed:
            at = Stored(reached.df.select("seed", "id"), reached.rows, reached.bytes)
            links = skew_join(store.met(at, near, *EDGE), seed_names, "seed", left_keys=reached.df)
    else:
        # seeds get their names while rows are pairs of numbers: no row with its attributes moves for that
        hot = [] if seed_names.small else hot_keys(reached.df.select("seed"), "seed")
        named = cut(skew_join(reached.df, seed_names, "seed", hot_left=hot).select("seed_id", "id", "hop"), "reached")
        # what is read from here on are the named rows, and the edges if they are asked for
        discard(nodes.sparkSession, [*reached.paths, *start.paths, *([*store.files, *store.laid] if own and not crossed else ())])
        often = hot_keys(named.df.select("id"), "id")
        found = skew_join(named.df, attributes, "id", hot_left=often)
        if crossed:
            links = store.met(named.select("seed_id", "id"), near, *EDGE, often=often)
    return found, links


def upstream(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, store: GraphStore | None = None, crossed: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Where the data of ``seeds(node_id)`` comes from, up to ``depth`` edges away.

    Returns nodes with their hop (0 .. depth-1) per seed and the edges crossed per seed. Ids
    without a node row are passed through but not listed. The result has one row per seed and thing reached, so
    many seeds over hubs give a result of the size of the closure; that is what is asked for. ``store`` is the graph laid
    out before (``adjacency.graph_store``), for many questions to one graph. With ``crossed`` off there is None instead of the
    edges, and their attributes are neither read nor stored. Starts jobs.
    """
    return _traverse(nodes, edges, seeds, depth, "target_id", store, crossed)


def downstream(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, store: GraphStore | None = None, crossed: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Where the data of ``seeds(node_id)`` goes to; see ``upstream``."""
    return _traverse(nodes, edges, seeds, depth, "source_id", store, crossed)

"""The lineage graph laid out for traversal: node numbers, and the edges bucketed by the end that a question starts from.

A node's number is a hash of its id. That no two nodes share one is proved when the store is built; should some do, all
but the first of them get numbers below zero, which no hash has. Numbering an edge therefore needs no join.

The edges are stored once as they come; their numbers are made as they are read. A frontier that was measured small is broadcast to them. For
larger ones they are written once more for each end, bucketed by (number of that end, lane), when first needed. A hop joins
a frontier to the bucketed copy: only the frontier is shuffled, no edge moves. Ends with more edges than a task should read are found when the store
is built, from exact counts; their edges are dealt over lanes, and a frontier row of such a node is copied per lane.

A store for a single question deletes what the bucketed edges replace, and one for nodes only holds no more of an edge than its ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siltworks.operators.skew import hot_among, hot_keys, skew_join, tasks
from siltworks.sources.scratch import Stored, cut, discard, freed_shuffles, scratch_path

EDGE = ["source_id", "target_id", "script", "dag_id", "layer", "transformations"]
NUMBERS = {"source_id": "source", "target_id": "target"}
OTHER = {"source_id": "target_id", "target_id": "source_id"}


def node_number(node_id: Column) -> Column:
    """63 bits; NULL for NULL, which meets nothing."""
    return F.when(node_id.isNotNull(), F.xxhash64(node_id).bitwiseAND(F.lit((1 << 63) - 1)))


def bucketed(df: DataFrame, columns: Sequence[str], buckets: int, label: str) -> tuple[DataFrame, str]:
    """``df``, partitioned by ``columns``, written once to the shared folder in as many files, which Spark knows when it reads
    them; and their path. Sorted in a file, so that equal texts lie together and take little room.

    The catalog entry that Spark needs for that is dropped again at once; the frame keeps the layout.
    """
    spark = df.sparkSession
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    df.write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return found, path


@dataclass(frozen=True)
class GraphStore:
    """``names``: (id, node_id, source_edges, target_edges) of every node; ``plain``: the edges as they came, with numbers;
    ``edges``: by end, the distinct edges bucketed by it, with ``columns``, and ``laid`` their folders. ``files``: folders that are
    deleted as soon as edges are bucketed."""

    names: Stored
    clashes: Stored | None
    plain: DataFrame
    buckets: int
    columns: Sequence[str] = tuple(EDGE)
    files: tuple[str, ...] = ()
    edges: dict[str, DataFrame] = field(default_factory=dict)
    hot: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    laid: list[str] = field(default_factory=list)
    apart: list[str] = field(default_factory=list)  # folders of edges of frequent nodes, see ``met``

    def numbered(self, df: DataFrame, column: str, alias: str) -> DataFrame:
        """``df`` with the number of the node in ``column``."""
        number = node_number(F.col(column))
        if self.clashes is None:
            return df.withColumn(alias, number)
        named = self.clashes.df.select(F.col("node_id").alias(column), "_other")
        met = skew_join(df, Stored(named, self.clashes.rows, self.clashes.bytes), column, "left")
        return met.withColumn(alias, F.coalesce("_other", number)).drop("_other")

    def add_end(self, near: str) -> None:
        """Write the distinct edges bucketed by their end ``near``."""
        number, other = NUMBERS[near], NUMBERS[OTHER[near]]
        self.hot[near] = hot = hot_among(self.names.df, "id", f"{number}_edges")
        # the number of the other end is made as the edges are read, where its text is there
        late = self.clashes is None and OTHER[near] in self.columns
        rows = self.plain.filter(F.col(near).isNotNull()).select(number, *([] if late else [other]), *self.columns)
        rows = self._laned(rows, near, number)
        if hot:  # many copies of one edge make its ends hot; fold them before they meet
            rows = rows.filter(F.col("_lanes").isNull()).unionByName(rows.filter(F.col("_lanes").isNotNull()).distinct())
        dealt = F.pmod(F.xxhash64(*(self.columns or [other])), F.col("_lanes"))
        # else always 0, but no literal: that would be folded, and the rows be shuffled once more to be distinct
        zero = F.pmod(F.xxhash64(number), F.lit(1))
        rows = rows.withColumn("lane", F.when(F.col("_lanes").isNotNull(), dealt).otherwise(zero).cast("int")).drop("_lanes")
        ready = rows.repartition(self.buckets, number, "lane").distinct()  # no shuffle for the latter
        laid, path = bucketed(ready, [number, "lane"], self.buckets, "edges_by_end")
        self.edges[near] = laid.withColumn(other, node_number(F.col(OTHER[near]))) if late else laid
        self.laid.append(path)
        discard(laid.sparkSession, self.files)

    def _laned(self, rows: DataFrame, near: str, number: str) -> DataFrame:
        if not self.hot[near]:
            return rows.withColumn("_lanes", F.lit(None).cast("int"))
        kind = T.StructType([T.StructField(number, T.LongType()), T.StructField("_lanes", T.IntegerType())])
        # bounded as in hot_among
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(self.hot[near], kind)), number, "left")

    def met(self, at: Stored, near: str, *columns: str, once: bool = True, often: list[tuple] | None = None) -> DataFrame:
        """Rows of ``at`` (with a node number ``id``) joined to the edges whose ``near`` end that node is.

        A measured small ``at`` is broadcast. An edge that comes several times counts once, unless ``once`` is off. Otherwise only ``at`` is shuffled, to the buckets of the edges. A node that is
        frequent in ``at`` itself is met apart: the edges of such nodes are few and go to its rows. ``often`` are these nodes
        where they are known (see ``hot_keys``).
        """
        number = NUMBERS[near]
        if at.small:
            edges = self.edges.get(near, self.plain).select(F.col(number).alias("id"), *columns)
            found = edges.join(F.broadcast(at.df), "id")
            return found.distinct() if once and near not in self.edges else found  # of what was met only
        if near not in self.edges:
            self.add_end(near)
        edges = self.edges[near].select(F.col(number).alias("id"), "lane", *columns)
        rows, apart = at.df, None
        often = hot_keys(rows.select("id"), "id") if often is None else often
        if often:
            keys = rows.sparkSession.createDataFrame([(k,) for k, _ in often], "id bigint")  # bounded as in hot_keys
            some = cut(edges.join(F.broadcast(keys), "id", "left_semi").drop("lane"), "edges-of-frequent")
            self.apart.extend(some.paths)
            apart = skew_join(rows.join(F.broadcast(keys), "id", "left_semi"), some, "id", both=not some.small, hot_left=often)
            rows = rows.join(F.broadcast(keys), "id", "left_anti")
        rows = self._laned(rows, near, "id")
        # always 0, but no literal: that would leave the join condition and with it the buckets
        zero = F.pmod(F.xxhash64("id"), F.lit(1)).cast("int")
        copies = F.explode(F.when(F.col("_lanes").isNotNull(), F.sequence(F.lit(0), F.col("_lanes") - 1)).otherwise(F.array(zero)))
        rows = rows.withColumn("lane", copies if self.hot[near] else zero).drop("_lanes")
        found = edges.join(rows, ["id", "lane"]).drop("lane")
        return found if apart is None else found.unionByName(apart)


def graph_store(
    nodes: DataFrame, edges: DataFrame, ends: Sequence[str] = (), columns: Sequence[str] = tuple(EDGE), only: str | None = None
) -> GraphStore:
    """Number all nodes of ``nodes`` and ``edges`` and store the edges; bucketed at once by each of ``ends``. Starts jobs.

    ``columns`` are what is kept of an edge besides the numbers of its ends: none is enough to ask for nodes. A store for a single
    question names the ``only`` end that this starts from: it deletes its names and plain edges when the edges are bucketed by that end.
    """
    with freed_shuffles(edges.sparkSession):
        store = _numbered_store(nodes, edges, columns, only)
        for near in ends:
            store.add_end(near)
    return store


def _numbered_store(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], only: str | None) -> GraphStore:
    numbers = {number: node_number(F.col(end)) for end, number in NUMBERS.items()}
    texts = edges.select(*dict.fromkeys([*NUMBERS, *columns]))
    # texts that are alike lie together, in the files and in the shuffle to the buckets
    kept = cut(texts.sortWithinPartitions(only) if only else texts, "edges")
    one, none = F.lit(1), F.lit(0)
    both = F.array(
        F.struct(F.col("source_id").alias("node_id"), one.alias("source_edges"), none.alias("target_edges")),
        F.struct(F.col("target_id").alias("node_id"), none.alias("source_edges"), one.alias("target_edges")),
    )
    lone = nodes.select("node_id", none.alias("source_edges"), none.alias("target_edges"))
    every = kept.df.select(F.inline(both)).unionByName(lone).filter(F.col("node_id").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("source_edges", "target_edges")]
    # numbered when they are counted: a number is longer in a shuffle than the part of an id in which it differs from its neighbour
    found = every.groupBy("node_id").agg(*sums).select(node_number(F.col("node_id")).alias("id"), "node_id", "source_edges", "target_edges")
    names = cut(found, "node-names")
    shared = names.df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    clashes, paths = None, (*kept.paths, *names.paths)
    if not shared.isEmpty():
        # of n nodes, about n * n / 2**64 share a number
        behind = names.df.join(shared, "id").withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("node_id"))).filter("_k > 1")
        clashes = cut(behind.select("node_id", (-1 - F.monotonically_increasing_id()).alias("_other")), "node-clashes")
        moved = names.df.join(clashes.df, "node_id", "left").withColumn("id", F.coalesce("_other", "id")).drop("_other")
        names = cut(moved, "node-names")
        paths += names.paths
    store = GraphStore(names, clashes, kept.df.withColumns(numbers), tasks(edges), columns)
    if clashes is not None:
        plain = store.plain
        for end, number in NUMBERS.items():
            plain = store.numbered(plain, end, number)
        again = cut(plain, "edges")
        paths += again.paths
        store = replace(store, plain=again.df)
    return replace(store, files=paths) if only else store

"""Connected components of a link table, as DataFrame jobs (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from siltworks.llm.common import stored


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, with their number and a checksum that the writing job takes along."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
    kept = stored(marked, "links")
    return kept, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, root): the smallest node that each linked node can reach. Starts jobs.

    Nodes without a link, loops and links with a NULL end give no row. Each round points every node at the smallest
    node it sees, first from the larger side, then from the smaller; rounds grow with the logarithm of the number of
    nodes. A round is written to the shared folder. A hub is one key of an equi-join, which AQE may split; its
    minimum is folded before the shuffle.
    """
    # u > v throughout
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = _kept(edges)
    while before[0]:
        # larger neighbours of a node move to the smallest node of its whole neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest_neighbour(both).withColumn("m", F.least("u", "m"))
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # seen from the smaller end
        large = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node and its smaller neighbours move to the smallest of them
        low = _smallest_neighbour(large)
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges, after = _kept(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

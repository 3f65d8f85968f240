"""Equi-joins that stay balanced when one key holds a large part of the rows.

Two tools:

* ``lookup`` joins facts to a dimension that is small by nature. Catalyst broadcasts the
  dimension when its measured size allows; if not, rows with a NULL key (which never match) are
  spread over all tasks instead of meeting in one.
* ``skew_join`` joins two inputs that both grow with the data. Keys that hold more rows than a task should are found
  once (``hot_keys``: counts by hash bucket propose them, an exact count decides) and handed to both sides as the same short list.
  Their rows are dealt over as many lanes as their count asks for, and the matching rows of the other side are
  copied once per lane. Every row of a dealt side meets exactly one copy, so the result is the plain join's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siltworks.sources.scratch import Stored, cut

# Lanes per task: with one lane per task, hashing would put several lanes of a hot key together.
LANES = 8
# A key is hot from this part of a task's mean rows on.
HOT = 0.5
LEAST_SHARE = 1e-4
BUCKETS = 1 << 14  # hash buckets in which rows are counted to find hot keys


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lanes(df: DataFrame) -> int:
    return LANES * tasks(df)


def spread(df: DataFrame, ways: int) -> Column:
    """Bucket in ``[0, ways)`` for a row.

    Hashes the whole row and the input partition it sits in: copies of a row that lie in
    different partitions separate, and a re-run of the same task gives the same bucket.
    Map values cannot be hashed and are left out.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(ways)).cast("int")


def lookup(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; NULL keys are spread, the join strategy is left to Catalyst."""
    lane = F.when(F.col(key).isNull(), spread(facts, lanes(facts))).otherwise(F.lit(0))
    # Always 0. A literal would be folded into the join condition and the lane would leave the hash key.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    return (
        facts.withColumn("_lane", lane)
        .join(dimension.withColumn("_lane", zero), [key, "_lane"], "left")
        .drop("_lane")
    )


def hot_lookup(facts: DataFrame, dimension: Stored, key: str) -> DataFrame:
    """Left join on ``key`` to a measured dimension; a hot key of the facts costs no task more than others.

    A dimension that fits is broadcast. Otherwise the dimension rows of just the hot keys are (they are few; should a hot
    key itself have many, the salted join takes over), and only facts of other keys are shuffled to meet the rest.
    Facts of hot keys and without key are spread. Looks for hot keys in one narrow job, if the dimension is large.
    """
    if dimension.small:
        return facts.join(F.broadcast(dimension.df), key, "left")
    hot = hot_keys(facts.select(key), key)
    if not hot:
        return lookup(facts, dimension.df, key)
    kind = T.StructType([facts.schema[key]])
    keys = F.broadcast(facts.sparkSession.createDataFrame([(k,) for k, _ in hot], kind))  # bounded as in hot_keys
    near = cut(dimension.df.join(keys, key, "left_semi"), "hot-dimension")
    if not near.small:
        return skew_join(facts, dimension.df, key, "left", hot_left=hot)
    others = [c for c in dimension.df.columns if c != key]
    held = near.df.select(F.col(key).alias("_key"), F.struct(*others).alias("_near"))
    known = keys.withColumnRenamed(key, "_hot")
    met = facts.join(F.broadcast(known), facts[key] == F.col("_hot"), "left").join(F.broadcast(held), F.col("_hot") == F.col("_key"), "left")
    # hot facts go on without a key: they are spread and meet nothing more
    met = met.withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key)))
    far = dimension.df.select(F.col(key).alias("_cold"), F.struct(*others).alias("_far"))
    met = lookup(met, far, "_cold")
    found = F.coalesce("_near", "_far")
    return met.select(*facts.columns, *(found[c].alias(c) for c in others))


def hot_keys(df: DataFrame, key: str) -> list[tuple]:
    """(value, lanes) of the keys with more than ``HOT`` of the rows that a task has on average.

    Rows are counted by hash bucket first. A hot key's bucket has as many rows, and at most ``1 / share`` buckets do; only rows of
    these are counted by key, so what is collected is bounded by twice the number of tasks (and by 10,000). Runs one job whose
    work per row is small, and a second one if there is such a bucket.
    """
    share = max(LEAST_SHARE, HOT / tasks(df))
    rows = df.select(key).withColumn("_bucket", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS))))
    every = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one list of ``BUCKETS`` pairs of numbers, of which the full ones are kept
    summed = every.agg(F.sum("_n").alias("total"), F.collect_list(F.struct("_bucket", "_n")).alias("each"))
    full = F.filter("each", lambda b: b["_bucket"].isNotNull() & (b["_n"] > F.lit(share) * F.col("total")))
    found = summed.select("total", F.transform(full, lambda b: b["_bucket"]).alias("full")).first()
    if not found["full"]:
        return []
    likely = F.broadcast(df.sparkSession.createDataFrame([(b,) for b in found["full"]], "_bucket bigint"))
    counted = rows.join(likely, "_bucket", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = found["total"]
    lane_rows = max(1.0, total / (2 * LANES * tasks(df)))
    hot = [(r[key], math.ceil(r["_n"] / lane_rows)) for r in counted.filter(F.col("_n") > share * total).collect()]
    return sorted(hot, key=repr)


def hot_among(counted: DataFrame, key: str, count: str) -> list[tuple]:
    """As ``hot_keys``, from a table that holds each key once with its number of rows. Runs two small jobs."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    share = max(LEAST_SHARE, HOT / tasks(counted))
    lane_rows = max(1.0, total / (2 * LANES * tasks(counted)))
    # at most 1 / share of them
    found = counted.filter(F.col(key).isNotNull() & (F.col(count) > share * total)).select(key, count).collect()
    return sorted(((r[key], math.ceil(r[count] / lane_rows)) for r in found), key=repr)


def _dealt(df: DataFrame, other: DataFrame, key: str, hot: list[tuple], salt: str, missing: bool) -> tuple[DataFrame, DataFrame]:
    """``df`` with a lane for each row of a hot key (and each row without key), ``other`` copied once per lane."""
    kind = T.StructType([df.schema[key], T.StructField("_lanes", T.IntegerType())])
    # one list for both sides, bounded as in hot_keys
    listed = F.broadcast(df.sparkSession.createDataFrame(hot, kind))
    if hot:
        df, other = df.join(listed, key, "left"), other.join(listed, key, "left")
    count = F.coalesce("_lanes", F.lit(1)) if hot else F.lit(1)
    # always 0, but no literal: that would be folded into the condition and leave the hash key
    lane = F.when(count > 1, F.pmod(spread(df, 1 << 30), count)).otherwise(F.pmod(F.xxhash64(key), F.lit(1)).cast("int"))
    if missing:
        lane = F.when(F.col(key).isNull(), spread(df, lanes(df))).otherwise(lane)
    df = df.withColumn(salt, lane).drop("_lanes")
    copies = F.explode(F.sequence(F.lit(0), count - 1)) if hot else F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    return df, other.withColumn(salt, copies).drop("_lanes")


def skew_join(
    left: DataFrame,
    right: DataFrame | Stored,
    key: str,
    how: str = "inner",
    both: bool = False,
    left_keys: DataFrame | None = None,
    hot_left: list[tuple] | None = None,
) -> DataFrame:
    """Join on ``key`` with the hot keys of the left side dealt over lanes. Starts a job to find them.

    ``how`` is inner, left, left_semi or left_anti. ``both`` also deals out the hot keys of the right side (inner only). A
    stored right side whose measured bytes fit is broadcast, which needs no shuffle of the left side at all and no
    job. ``left_keys`` is a cheaper input with the same ``key`` to look for hot keys in, when ``left`` itself is
    costly to compute twice; ``hot_left`` are the hot keys of the left side where they are known (see ``hot_among``).
    """
    if isinstance(right, Stored):
        if right.small and not both:
            return left.join(F.broadcast(right.df), key, how)
        right = right.df
    if both and how != "inner":
        raise ValueError("only an inner join can salt both sides")

    missing = how in ("left", "left_anti")  # rows without key stay, and must not meet in one task
    if hot_left is None:
        hot_left = hot_keys(left if left_keys is None else left_keys, key)
    hot_right = hot_keys(right, key) if both else []
    on = [key]
    if hot_left or missing:
        left, right = _dealt(left, right, key, hot_left, "_salt_l", missing)
        on.append("_salt_l")
    if hot_right:
        right, left = _dealt(right, left, key, hot_right, "_salt_r", False)
        on.append("_salt_r")
    return left.join(right, on, how).drop("_salt_l", "_salt_r")

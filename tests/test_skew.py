import pytest
from pyspark.sql import functions as F

from siltworks.operators import skew
from siltworks.operators.skew import hot_keys, hot_lookup, lookup, skew_join
from siltworks.sources import scratch
from siltworks.sources.scratch import cut


@pytest.fixture
def facts(spark):
    """A third of the rows on one key, a third without a key, and many copies of one row."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 3 == 1, F.concat(F.lit("k"), (n % 500).cast("string")))
    copies = F.when(n % 3 == 0, 0).otherwise(n)
    return spark.range(0, 6000, 1, 60).select(key.alias("key"), copies.alias("v")).cache()


@pytest.fixture
def names(spark):
    keys = ["hot", *[f"k{i}" for i in range(0, 300)], "unused"]
    return spark.createDataFrame([(k, k.upper()) for k in keys], "key string, name string")


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_the_plain_join(facts, names, rows, shuffled, how):
    assert rows(skew_join(facts, names, "key", how)) == rows(facts.join(names, "key", how))


def test_both_sides_hot(spark, facts, rows, shuffled):
    other = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.col("id").alias("w")
    )
    got = skew_join(facts, other, "key", both=True).groupBy("key", "v", "w").count()
    want = facts.join(other, "key").groupBy("key", "v", "w").count()
    assert rows(got) == rows(want)


def test_hot_key_copies_and_missing_keys_are_spread(facts, names, shuffled):
    def largest(joined, which):
        return max(sizes(joined.filter(which)))

    plain, salted = facts.join(names, "key", "left"), skew_join(facts, names, "key", "left")
    for which in (F.col("key") == "hot", F.col("key").isNull()):
        assert largest(plain, which) == 2000
        assert largest(salted, which) < 1200


def test_lookup_spreads_missing_keys(spark, names, rows, shuffled):
    facts = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 10 == 0, "k1").alias("key"), "id")
    joined = lookup(facts, names, "key")
    assert rows(joined) == rows(facts.join(names, "key", "left"))
    assert max(sizes(joined)) < 2000


def test_measured_small_side_is_broadcast(facts, names, rows):
    stored = cut(names, "test")
    assert (stored.rows, stored.small) == (302, True)
    joined = skew_join(facts, stored, "key", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    assert rows(joined) == rows(facts.join(names, "key", "left"))


def test_only_inner_joins_salt_both_sides(facts, names):
    with pytest.raises(ValueError):
        skew_join(facts, names, "key", "left", both=True)


def test_partition_order_does_not_matter(spark, facts, names, rows, shuffled):
    """Both sides use one list of hot keys, whatever order a sketch would see the rows in."""
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        backwards = facts.repartition(7, "v").sortWithinPartitions(F.desc("v"))
        for how in ("inner", "left", "left_semi", "left_anti"):
            assert rows(skew_join(backwards, names, "key", how)) == rows(facts.join(names, "key", how))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert [k for k, _ in hot_keys(facts, "key")] == [k for k, _ in hot_keys(backwards, "key")] == ["hot"]


def test_even_keys_are_not_copied(spark, shuffled):
    even = spark.range(4000).select((F.col("id") % 400).cast("string").alias("key"), "id")
    assert hot_keys(even, "key") == []
    names = even.select("key").distinct().withColumn("name", F.upper("key"))
    assert "Generate" not in skew_join(even, names, "key")._jdf.queryExecution().toString()


def test_lanes_follow_the_count(spark, shuffled):
    n = F.col("id")
    df = spark.range(8000).select(F.when(n % 2 == 0, "half").when(n % 8 == 1, "eighth").otherwise(n.cast("string")).alias("key"))
    lanes = dict(hot_keys(df, "key"))
    assert lanes["half"] == 32 and "7" not in lanes and lanes.get("eighth", 8) == 8


def test_hot_lookup_meets_a_broadcast_of_hot_rows_only(spark, rows, shuffled, monkeypatch):
    """A third of the facts has one key, and the dimension is too large to broadcast."""
    facts = spark.range(0, 6000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 900).cast("bigint").alias("k"))
    dimension = spark.range(800).select(F.col("id").alias("k"), F.concat(F.lit("name "), "id").alias("name")).union(spark.createDataFrame([(7, "again")], "k bigint, name string"))
    stored = cut(dimension, "dimension")
    want = rows(facts.join(dimension, "k", "left").select("id", "k", "name"))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 200)
    got = hot_lookup(facts, stored, "k")
    assert rows(got, "id", "k", "name") == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 6000 / len(sizes) * 1.3
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)  # even the hot rows are too many
    assert rows(hot_lookup(facts, stored, "k"), "id", "k", "name") == want
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 1 << 20)
    assert rows(hot_lookup(facts, stored, "k"), "id", "k", "name") == want


def test_stored_tables_know_the_bytes_of_their_columns(spark):
    kind = "k bigint, t string, l array<string>, n array<bigint>, m map<string,int>, s struct<a:string,b:int>"
    data = [(1, "abc", ["x", "yz"], [1, 2, 3], {"k": 1}, ("q", 1)), (2, None, None, None, None, None), (3, "é", [], [], {}, None)]
    stored = cut(spark.createDataFrame(data, kind), "widths")
    assert stored.rows == 3 and stored.bytes == sum(stored.widths.values())
    # 16 a scalar; a text its bytes and 16; a list 16 and its elements
    assert stored.widths["k"] == 48 and stored.widths["t"] == 3 + 2 + 48
    assert stored.widths["l"] == 3 * 16 + (1 + 16) + (2 + 16) and stored.widths["n"] == 3 * 16 + 3 * 16
    few = stored.select("k", "t")
    assert few.bytes == 48 + 53 and few.df.columns == ["k", "t"]
    assert stored.renamed({"k": "key"}).select("key").bytes == 48


def test_hot_keys_are_found_by_plain_counts(spark, facts, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "stat", None)  # no sketch, whose work per row grows with the number of tasks
    total = facts.count()
    share = skew.HOT / skew.tasks(facts)
    want = [r["key"] for r in facts.groupBy("key").count().collect() if r["key"] is not None and r["count"] > share * total]
    assert [k for k, _ in hot_keys(facts, "key")] == sorted(want)
    assert hot_keys(facts.limit(0), "key") == hot_keys(facts.filter("key IS NULL"), "key") == []

"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and numbered:
a block's integer name is its number. Then adjacent names are paired, the distinct pairs are sorted and
numbered again, and so on, until each document has one name. Two texts have the same (level, name) exactly
when they are equal: no digest decides.

At scale: text is shuffled once, when the distinct blocks are sorted (copies are folded before the shuffle).
Everything else carries integers: a block occurrence refers to its block by a 128-bit key, and the sorted
blocks prove that no two of them share a key (if two do, other keys are taken). Each level halves the rows.
A block or pair with a third of all occurrences is one row among the distinct ones; the join that hands names
back is a plain equi-join that AQE may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.llm.common import stored, texts

BLOCK = 1024
NONE = -1  # right name of a pair whose left block is the last one; numbers start at 0


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def block_key(block: Column, attempt: int) -> Column:
    """128 bits by which occurrences refer to a block; ``attempt`` gives another key for every block."""
    return F.struct(
        F.xxhash64(F.lit(2 * attempt), block).alias("a"), F.xxhash64(F.lit(2 * attempt + 1), block).alias("b")
    )


def _blocks(text: Column, size: int) -> Column:
    raw = F.encode(text, "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows sorted within their hash partition and numbered: unique and the same in a rerun of a task."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def block_names(
    docs: DataFrame, size: int = BLOCK, key: Callable[[Column, int], Column] = block_key
) -> tuple[DataFrame, DataFrame]:
    """Number every row and name its text: ``(rows, identities)``.

    ``rows`` has _rid, doc_id, text_sha256; ``identities`` has _rid, doc_id, level, name. Starts jobs.
    """
    rows = texts(docs).withColumn("text", normalised(F.col("text")))
    attempt = 0
    while True:
        blocks = _blocks(F.col("text"), size)
        refs = stored(
            rows.select(
                F.monotonically_increasing_id().alias("_rid"),
                "doc_id",
                F.sha2("text", 256).alias("text_sha256"),
                F.transform(blocks, lambda x: key(x, attempt)).alias("keys"),
            ),
            "exact-refs",
        )
        pieces = rows.select(F.explode(blocks).alias("block"))
        pieces = pieces.select(key(F.col("block"), attempt).alias("k"), "block").select("k.a", "k.b", "block")
        names = stored(_numbered(pieces.distinct(), "a", "b", "block").select("a", "b", "name"), "exact-names")
        if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
            break
        attempt += 1
    at = refs.select("_rid", "doc_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k"))
    at = at.select("_rid", "doc_id", "n", "pos", "k.a", "k.b").join(names, ["a", "b"])
    at = stored(at.select("_rid", "doc_id", "n", "pos", "name"), "exact-level")

    longest = refs.select(F.max(F.size("keys"))).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(at.filter("n = 1").select("_rid", "doc_id", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        even = F.col("pos") % 2 == 0
        pairs = (
            at.filter("n > 1")
            .groupBy("_rid", "doc_id", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("r"),
            )
        )
        named = _numbered(pairs.select("l", "r").distinct(), "l", "r")
        at = stored(pairs.join(named, ["l", "r"]).select("_rid", "doc_id", "n", "pos", "name"), "exact-level")
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return refs.drop("keys"), identities


def exact_dedup(
    docs: DataFrame, size: int = BLOCK, key: Callable[[Column, int], Column] = block_key
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Starts jobs while it is built.

    Texts are equal when identical after each run of white space (space, tab to carriage return) became one space.
    NULL texts count as empty, and all empty texts are one group. Of rows that repeat a doc_id and its text, one
    stays. A row without doc_id stays only if no row of its group has one; keep_id is then NULL.
    Of an empty table the result is empty. Other columns are ignored, whatever their names.
    """
    rows, identities = block_names(docs, size, key)
    groups = identities.groupBy("level", "name").agg(
        F.min("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.min_by("_rid", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("_keep"),
    )
    return (
        identities.drop("doc_id").join(groups, ["level", "name"])
        .select("_rid", "keep_id", "group_size", (F.col("_rid") == F.col("_keep")).alias("kept"))
        .join(rows, "_rid")
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )

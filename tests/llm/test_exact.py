import hashlib
import re

from pyspark.sql import functions as F

from siltworks.llm.exact import block_key, exact_dedup


def plain(pairs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    out = []
    for (i, _), t in zip(pairs, norm):
        ids = [j for (j, _), u in zip(pairs, norm) if u == t]
        known = [j for j in ids if j is not None]
        out.append((i, min(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_awkward_rows(awkward):
    got = exact_dedup(awkward).collect()
    want = plain(pairs_of(awkward))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    # one row of each group stays
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_small_blocks_give_many_levels(documents):
    pairs = [(k, "ab" * (k // 3) + "c" * (k % 3 == 2)) for k in range(60)] + [(100, "ab" * 7), (99, "ab" * 7)]
    got = exact_dedup(documents(pairs), size=3)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=repr) == plain(pairs)


def test_blocks_that_share_a_key_are_told_apart(documents):
    def weak(block, attempt):
        if attempt < 2:  # every block has one of two keys
            return F.struct(F.pmod(F.xxhash64(block), F.lit(2)).alias("a"), F.lit(0).cast("bigint").alias("b"))
        return block_key(block, attempt)

    pairs = [(k, f"text {k % 5}") for k in range(12)]
    got = exact_dedup(documents(pairs), key=weak)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=repr) == plain(pairs)


def test_empty_table(nothing):
    assert exact_dedup(nothing).collect() == []

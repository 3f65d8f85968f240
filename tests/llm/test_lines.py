import random

import pytest
from brute import edit_distance, groups
from pyspark.sql import functions as F

from siltworks.llm import lines


def plain(pairs, edits, least):
    found = []
    for i, text in pairs:
        for k, line in enumerate((text or "").split("\n")):
            line = " ".join(line.split())
            if len(line) >= least:
                found.append((i, k, line))
    kinds = sorted({x[2] for x in found})
    near = {(a, b) for a in range(len(kinds)) for b in range(a + 1, len(kinds)) if abs(len(kinds[a]) - len(kinds[b])) <= edits and edit_distance(kinds[a], kinds[b]) <= edits}
    roots = dict(zip(kinds, groups(len(kinds), lambda a, b: (a, b) in near)))
    links = {t: sum(k in p for p in near) for k, t in enumerate(kinds)}
    out = []
    for i, k, t in found:
        firsts = [(d, n) for d, n, u in found if roots[u] == roots[t] and d is not None]
        first = min(firsts, default=(None, 0))
        out.append((i, k, first[0], links[t], first[0] is None or (i, k) == first))
    return sorted(out, key=repr)


def answer(df, edits, least, dense=lines.DENSE):
    return sorted(((r.doc_id, r.line_no, r.class_doc, r.n_links, r.kept) for r in lines.line_classes(df, edits, least, dense).collect()), key=repr)


@pytest.mark.parametrize("edits, dense", [(0, 64), (1, 64), (1, 1), (1, 3), (2, 64), (3, 64)])
def test_against_all_pairs(documents, edits, dense):
    rnd = random.Random(edits)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(9, 16))).strip() for _ in range(25)]
    pairs = []
    for k in range(30):
        some = []
        for _ in range(4):
            line = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(line))
                line[at : at + 1] = rnd.choice([[], ["x"], [line[at], "y"]])
            some.append("".join(line))
        pairs.append((k, "\n".join(some)))
    assert answer(documents(pairs), edits, 8, dense) == plain(pairs, edits, 8)


@pytest.mark.parametrize("dense", [1, 5, 1000])
def test_many_lines_one_edit_from_one(documents, unbroadcast, dense):
    """Lines that all share a segment are linked by pattern: same classes and numbers of links, no pairs."""
    rnd = random.Random(dense)
    base = "aab cdd éef ggh iij"
    kinds = {base}
    for _ in range(90):
        line = list(rnd.choice([base, rnd.choice(sorted(kinds))]))
        at = rnd.randrange(len(line))
        line[at : at + 1] = rnd.choice([[rnd.choice("axyé")], [], [line[at], line[at]], ["z", line[at]]])
        kinds.add(" ".join("".join(line).split()))
    pairs = [(k, line + "\n" + rnd.choice(sorted(kinds))) for k, line in enumerate(sorted(kinds))]
    assert answer(documents(pairs), 1, 8, dense) == plain(pairs, 1, 8)


def test_band_distance(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(8, 30)))
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(b))
            b[at : at + 1] = rnd.choice([[], ["c"], [b[at], "a"]])
        rows.append((a, "".join(b)))
    frame = spark.createDataFrame([r for r in rows if len(r[1]) >= 6], "x string, y string")
    for edits in (0, 1, 3, 5):
        cap = F.lit(edits + 1)
        wrong = F.least(F.levenshtein("x", "y"), cap) != F.least(lines.band_distance(F.col("x"), F.col("y"), edits), cap)
        assert frame.filter(wrong).count() == 0
        parts = frame.filter(F.least(F.length("x"), F.length("y")) > edits).select("x", "y", lines.unlike_part(F.col("x"), F.col("y"), edits + 1).alias("p")).select("x", "y", F.col("p.x").alias("u"), F.col("p.y").alias("v"))
        wrong = F.least(F.levenshtein("x", "y"), cap) != F.least(lines.band_distance(F.col("u"), F.col("v"), edits), cap)
        assert parts.filter(wrong).count() == 0 and parts.filter(F.length("u") < F.length("x")).count() > 0


def test_awkward_rows(awkward, nothing, unbroadcast):
    pairs = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id not in (6, 7)]
    assert answer(awkward.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)"), 1, 20) == plain(pairs, 1, 20)
    long = lines.line_classes(awkward).filter("doc_id IN (6, 7)").collect()
    assert sorted((r.doc_id, r.line_no, r.class_doc, r.kept) for r in long) == [(6, 0, 6, True), (6, 1, 6, True), (7, 0, 6, False), (7, 1, 6, False)]
    assert lines.line_classes(nothing).count() == 0 and lines.dedup_lines(nothing).count() == 0


def test_texts_without_their_repeated_lines(awkward):
    left = lines.dedup_lines(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    text = {r.doc_id: r.text for r in left.collect() if r.doc_id is not None}
    assert text[1] == "A line of text that is long enough.\nAnother line, which is also long enough."
    assert text[2] == "" and text[12] == "new" and text[3] is None and text[5] == " \t\n " and text[8] == "Short."
    assert text[7] == "" and len(text[6]) > 400_000

import re
import tracemalloc
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from siltworks.llm import collocations
from siltworks.llm.collocations import collocations as mine, scored


def plain(pairs, least, top):
    """The contract, phrase by phrase."""
    counts, totals = {}, Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            held = counts.setdefault(lang, Counter())
            for n in range(1, 6):
                held.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, held in counts.items():
        found = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p) and a >= held[p[i:j]]:
                        inside.add(p[i:j])
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), held[p[:k]], held[p[k:]]))
        for rank, (score, a, _, phrase, l, r) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase, -a, l, r, totals[lang], -score))
    return sorted(out, key=repr)


@pytest.fixture
def corpus(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    pairs = [(r.lang, r.text) for r in texts]
    pairs += [(None, "Never A B c d e f. " * 12), ("en", "x y z" * 9), ("en", None), ("fr", ""), ("xx", "one, two; three"), ("en", "A\tB\x0bA\tB  A  B\x1c")]
    pairs += [("zz", "a b a b a b a b a b\n" * 30 + "\u0085 q r \u0085 q r " * 20)]
    return pairs


def frame(spark, pairs):
    rows = [(k, t, lang, "s", "x", 1, "x", 1, "x") for k, (lang, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, phrase string, f int, word string, n int, bound string").repartition(3)


@pytest.mark.parametrize(("least", "top", "width"), [(6, 2000, 1 << 16)])
def test_against_plain_counts(spark, rows, corpus, least, top, width):
    assert rows(mine(frame(spark, corpus), least, top, width)) == plain(corpus, least, top)


def test_bitmaps_that_let_all_through_change_nothing(spark, rows, corpus, monkeypatch):
    monkeypatch.setattr(collocations, "AT_ONCE", 900)
    monkeypatch.setattr(collocations, "WINDOW", 60)
    assert rows(mine(frame(spark, corpus), 9, 40, 16, bits=8)) == plain(corpus, 9, 40)


def test_few_nodes_are_grown_when_the_bound_settles_it(spark, rows, monkeypatch):
    # two hundred rare pairs outscore everything that frequent words can reach
    pairs = [("en", " . ".join(f"r{k} s{k}" for k in range(200)) + " . " + "the of " * 400)] * 6
    seen = []
    real = collocations._suffixes
    monkeypatch.setattr(collocations, "_suffixes", lambda nodes: seen.append({r.phrase for r in nodes.collect()}) or real(nodes))
    assert rows(mine(frame(spark, pairs), 6, 50, 32)) == plain(pairs, 6, 50)
    assert "the" not in set().union(*seen)


def test_large_products_stay_exact(spark):
    a, l, r, n = 10**13 + 7, 3 * 10**14 + 1, 10**13 + 9, 9 * 10**16 + 5  # noqa: E741
    known = spark.createDataFrame([("en", "a", l), ("en", "b", r)], "lang string, phrase string, f bigint")
    got = scored(spark.createDataFrame([("en", "a b", 2, a, n)], "lang string, phrase string, n_words int, f bigint, n bigint"), known).first()
    assert got.score == 1000 * a * n // (l * r)
    assert Decimal(got.score) == Decimal(1000 * a * n) // Decimal(l * r)


def test_empty_table(spark):
    assert mine(frame(spark, [("en", "x")]).limit(0)).collect() == []


def test_a_pass_over_a_full_slice_takes_little_memory():
    rnd = np.random.default_rng(3)
    held, bits = collocations.Slice(), 1 << 20
    while held.words < collocations.AT_ONCE:
        held.add("en", b" ".join(b"w%d" % k for k in rnd.integers(0, 5000, 100_000).tolist()))
    held.hashes()
    every = np.full(bits // 8, 255, dtype=np.uint8)
    for made in (
        lambda: collocations.count_hashes(held, every, every, bits),
        lambda: collocations.reduced_texts(held, every, every, every, bits),
        lambda: collocations.count_grown(held, every, every, every, every, bits),
    ):
        tracemalloc.start()
        assert sum(b.num_rows for b in made()) > 0
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 180_000_000


def test_words_are_numbered_in_bulk():
    rnd = np.random.default_rng(5)
    texts = ["".join(rnd.choice(list("aB é\t\n.,!x\x1c"), 300)) for _ in range(20)] + ["", " ", ".", "w" * 500 + " b"]
    held = collocations.Slice()
    want = []
    for k, t in enumerate(texts):
        held.add(("en", "de")[k % 2], t.encode())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            want += [*((("en", "de")[k % 2], w) for w in re.findall(r"[^\x20\x09]+", piece)), None]
    token = held.tokens()[1 : -collocations.LONGEST]
    words, langs = held.text(token, b"|").to_pylist(), held.langs(token).to_pylist()
    assert [None if w == "|" else (lang, w) for lang, w in zip(langs, words, strict=True)] == want
    # one number and one hash for a word of a language, the same in bitmaps
    pairs = sorted({p for p in want if p})
    assert len(held.names) == len(pairs) + 1
    bits = dict(zip(zip(held.langs(np.arange(1, len(held.names))).to_pylist(), held.text(np.arange(1, len(held.names))).to_pylist(), strict=True), held.hashes()[1:], strict=True))
    got = collocations.phrase_bits([p[0] for p in pairs], [p[1] for p in pairs], 1 << 27)
    assert got.tolist() == [int(bits[p]) % (1 << 27) for p in pairs]


def test_hashes_are_counted_by_bucket(spark):
    held = collocations.Slice()
    for _ in range(3):
        held.add("en", b"a b a b c")
    bits = 1 << 17
    every = np.full(bits // 8, 255, dtype=np.uint8)
    made = pa.Table.from_batches(list(collocations.count_hashes(held, every, every, bits, 6)))
    found = collocations.enough_of(spark.createDataFrame(made.to_pandas(), collocations.HASHES), 6, bits)
    assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == collocations.phrase_bits(["en"], ["a b"], bits).tolist()
    twice = spark.createDataFrame(pa.concat_tables([made, made]).to_pandas(), collocations.HASHES)
    found = collocations.enough_of(twice, 6, bits)
    # each child of up to five words, three times in a table of counts up to 6
    some = ["a b", "b a", "b c", "a b a", "b a b", "a b c", "a b a b", "b a b c", "a b a b c"]
    assert set(np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist()) == set(collocations.phrase_bits(["en"] * 9, some, bits).tolist())

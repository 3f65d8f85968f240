import random

import numpy as np
import pytest
from brute import fingerprint, groups

from siltworks.llm import simhash
from siltworks.llm.components import components


def test_fingerprints():
    texts = ["", " \t\n", "one", "One two", "a b c d", "A B C D e", "ä b c d e f " * 9, "x " * 300]
    assert [simhash.fingerprint(t) for t in texts] == [fingerprint(t) for t in texts]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [0, 1, 4, 8])
def test_every_link_is_found(spark, distance):
    rnd = random.Random(distance)
    prints = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(4):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, distance + 2))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = sorted((r.a, r.b, r.bits) for r in simhash.search(frame, distance).collect())
    want = [(*sorted((signed(a), signed(b))), (a ^ b).bit_count()) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= distance]
    assert got == sorted(want)


def test_full_values_are_dealt_over_lanes(spark, monkeypatch):
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(80)})
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    plan = simhash.make_plan(np.array(prints, dtype=np.uint64), len(prints))
    whole = sorted(simhash.links(frame, plan).collect())
    monkeypatch.setattr(simhash, "LANE", 4)
    assert sorted(simhash.links(frame, plan).collect()) == whole and len(whole) > 80


def test_thresholds_keep_the_pigeonhole_sum():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for rows in (10, 10**5, 10**8):
        plan = simhash.make_plan(sample, rows)
        assert sum(plan.thresholds) == simhash.DISTANCE - len(plan.masks) + 1
        assert sum(plan.masks) == (1 << 64) - 1


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = {frozenset(p) for p in pairs}
    nodes = sorted({x for p in pairs for x in p})
    want = groups(len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in linked)
    known = {n: nodes[r] for n, r in zip(nodes, want)}
    assert all(known[n] == r for n, r in got.items())
    assert set(got) >= {n for n in nodes if list(known.values()).count(known[n]) > 1}


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, fingerprint(r.text or "")) for r in awkward.collect()]
    roots = groups(len(rows), lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count() <= 4)
    ids = lambda r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None)
    want = [(i, f"{p:016x}", ids(r)) for (i, p), r in zip(rows, roots)]
    assert sorted(map(tuple, simhash.near_duplicates(awkward).collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(nothing).count() == simhash.one_of_each(nothing).count() == 0


def test_one_of_each(documents, awkward):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(400)]
    docs = documents([(5, " ".join(words)), (3, " ".join(near)), (7, " ".join(other)), (9, " ".join(words)), (None, " ".join(words))])
    assert sorted((r.doc_id for r in simhash.one_of_each(docs).collect()), key=repr) == [3, 7, None]
    left = simhash.one_of_each(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 3, 6, 8, 8, 9, 10, 11, 12]


def test_similar_texts_far_apart_in_bits(documents, monkeypatch):
    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    while len(texts) < 40:
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 100))] + passage
        copy = list(words)
        for at in rnd.sample(range(5, len(words) - 5), 2):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts += [" ".join(words), " ".join(copy)]
    apart = lambda a, b: (fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count()
    near = [(a, b) for a in range(40) for b in range(a + 1, 40) if jaccard(texts[a], texts[b]) >= 0.8]
    assert sum(apart(a, b) > 8 for a, b in near) >= 3
    want = sorted(set(groups(40, lambda a, b: (a, b) in near or apart(a, b) <= 4)))
    assert [r.doc_id for r in simhash.one_of_each(documents(list(enumerate(texts)))).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(simhash, "LANE", 2)  # dealt over lanes
    assert [r.doc_id for r in simhash.one_of_each(documents(list(enumerate(texts)))).orderBy("doc_id").collect()] == want


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    from siltworks.llm import components

    written, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label: written.append(label) or stored(df, label))
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    found = components.components(chain)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before == len(written)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)] + [(100, 100), (101, 100)]
    assert components.components(chain.limit(0)).collect() == []


def test_shared_passages_do_not_make_texts_meet(documents, monkeypatch):
    """However many documents there are, texts that share only a passage do not meet at its shingles."""
    monkeypatch.setattr(simhash, "ORDERED", 16)
    rnd = random.Random(6)
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(4)]
    texts = [" ".join([*(f"w{rnd.randrange(10**9)}" for _ in range(60)), *(passages[k % 10] if k % 10 < 4 else [])]) for k in range(2000)]
    docs = documents(list(enumerate(texts)))
    first = simhash.near_units(docs, simhash.common_shingles(docs), 0.8).selectExpr("explode(first) AS x")
    assert first.groupBy("x").count().agg({"count": "max"}).first()[0] < 5


def test_order_of_shingles_goes_by_their_counts():
    common = simhash.Common(np.array([-3, 4, 9]), np.array([7, 50, 4]))
    shingles = np.array([-5, -3, 4, 8, 9])
    assert simhash.prefix(shingles, common, 0.01).tolist() == [-5, 8, 9, -3, 4]
    assert simhash.prefix(shingles, common, 0.8).tolist() == [-5, 8]
    assert simhash.prefix(shingles, simhash.Common(*np.zeros((2, 0), dtype=np.int64)), 0.8).tolist() == [-5, -3]


def test_similar_texts_link_whole_components(documents, monkeypatch):
    rnd = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        for changed in range(6):  # similar neighbours, whatever their fingerprints are
            texts.append(" ".join([*words[:changed], *(f"x{rnd.randrange(10**6)}" for _ in range(1)), *words[changed + 1 :]]))
    docs = documents(list(enumerate(texts)))
    calls, components = [], simhash.components

    def seen(links):
        found = components(links)
        calls.append(([tuple(r) for r in links.collect()], [tuple(r) for r in found.collect()]))
        return found

    monkeypatch.setattr(simhash, "components", seen)
    monkeypatch.setattr(simhash, "MET_BYTES", -1)  # shingles of several texts not broadcast
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [6 * k for k in range(12)]
    (sure, roots), (more, _) = calls
    assert sure and more and len(calls) == 2
    root = dict(roots)
    assert all(a != b and root.get(a, a) == a and root.get(b, b) == b for a, b in more)

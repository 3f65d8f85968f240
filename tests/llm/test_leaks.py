import random

import pytest

from siltworks.llm import leaks


def words(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def edited(rnd, text, share):
    out = []
    for c in text:
        r = rnd.random()
        if r < share / 3:
            continue
        out.append(rnd.choice("abcdefgh") if r < 2 * share / 3 else c)
        if 2 * share / 3 <= r < share:
            out.append(rnd.choice("abcdefgh"))
    return "".join(out)


@pytest.fixture
def benchmark(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "item_id bigint, text string, doc_id string, start string")

    return build


def test_distance_to_any_part():
    from brute import edit_distance

    rnd = random.Random(3)
    for _ in range(150):
        item = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12)))
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 20)))
        best = min(edit_distance(item.decode(), text[i:j].decode()) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert leaks.best_distance(item, text)[0] == best


def test_recall_and_precision(documents, benchmark):
    rnd = random.Random(7)
    items = [(k, words(rnd, rnd.randint(15, 50))) for k in range(40)]
    docs = []
    for k, (_, t) in enumerate(items):
        docs.append((k, words(rnd, 200) + ". " + t.upper() + "; " + words(rnd, 100)))
        docs.append((100 + k, words(rnd, 90) + " " + edited(rnd, t, 0.06) + " " + words(rnd, 90)))
        docs.append((200 + k, words(rnd, 300)))
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(documents(docs), benchmark(items)).collect()}
    assert {(k, k) for k in range(40)} <= got
    assert len({(100 + k, k) for k in range(40)} & got) >= 36
    assert not any(d >= 200 for d, _ in got)
    assert all(d % 100 == i for d, i in got)


def test_brief_items_are_all_found():
    rnd = random.Random(5)
    items = [(k, leaks.reduced(words(rnd, 12).encode())[: rnd.randint(24, 47)].strip()) for k in range(60)] + [(90, leaks.reduced(words(rnd, 60).encode()))]
    items = [(k, t) for k, t in items if len(t) >= 24]
    texts = []
    for k, (_, t) in enumerate(items[:-1]):
        changed = bytearray(t)
        for _ in range((0, int(0.2 * len(t)))[k % 2]):  # word for word, or as many edits as are accepted
            at = rnd.randrange(len(changed))
            changed[at : at + 1] = rnd.choice([b"", b"x", bytes([changed[at]]) + b"y"])
        texts.append(leaks.reduced(words(rnd, rnd.choice([1, 60, 6000] if k < 8 else [1, 60])).encode()) + b" q" + bytes(changed) + b"q " + leaks.reduced(words(rnd, 50).encode()))
    texts += [b"", items[0][1], items[1][1][:20]]
    index = leaks.Index(items)
    got = {(d, k): n for d, k, _, _, n in index.search(texts, index._filters())}
    want = {(d, k): n for d, t in enumerate(texts) for k, (_, i) in enumerate(items) if len(i) < 48 and (n := leaks.best_distance(i, t)[0]) <= int(0.2 * len(i) + 1e-9)}
    assert {p: n for p, n in got.items() if p[1] < len(items) - 1} == want and len(want) >= len(items) - 1


def test_a_benchmark_in_chunks_gives_the_same(documents, benchmark):
    rnd = random.Random(9)
    items = [(k, words(rnd, 30)) for k in range(8)] + [(50, "tiny item"), (51, None), (52, ""), (53, "!!")]
    docs = documents([(k, words(rnd, 40) + " " + (t or "") + " " + words(rnd, 40)) for k, t in items])
    whole = sorted(leaks.find_leaks(docs, benchmark(items)).collect())
    assert sorted(leaks.find_leaks(docs, benchmark(items), chunk=300).collect()) == whole
    assert {(r.doc_id, r.item_id) for r in whole} == {(k, k) for k in [*range(8), 50]}


def test_awkward_rows(awkward, nothing, benchmark):
    items = benchmark([(1, "a line of text that is long enough"), (1, "a line of text that is long enough"), (None, "a row without a number but with a text of some length")])
    got = leaks.find_leaks(awkward, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(1, 1), (2, 1), (12, 1), (None, None)], key=repr)
    stay = leaks.clean(awkward, items)
    assert stay.columns == awkward.columns
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in awkward.collect()} - {1, 2, 12}
    assert leaks.find_leaks(nothing, items).count() == leaks.find_leaks(awkward, items.limit(0)).count() == 0


def test_every_match_up_to_the_threshold_is_found():
    rnd = random.Random(13)
    items = [(k, leaks.reduced(words(rnd, rnd.randint(10, 60)).encode())) for k in range(24)]
    items = [(k, t) for k, t in items if len(t) >= leaks.BRIEF]
    docs = [b""]
    for k, (_, t) in enumerate(items):
        for edits in (int(0.2 * len(t) + 1e-9), int(0.16 * len(t))):  # at the threshold, and below
            changed = bytearray(t)
            for j, at in enumerate(sorted(rnd.sample(range(len(t)), edits) if k % 2 else [i * len(t) // edits for i in range(edits)], reverse=True)):
                changed[at : at + 1] = (b"", b"#", bytes([changed[at]]) + b"7")[(j + k) % 3]
            around = [b"", leaks.reduced(words(rnd, 40).encode())]
            docs.append(around[k % 2] + bytes(changed) + around[edits % 2])
    index = leaks.Index(items)
    got = {(d, k): n for d, k, _, _, n in index.search(docs, index._filters())}
    best = {(d, k): leaks.best_distance(t, text)[0] for d, text in enumerate(docs) for k, (_, t) in enumerate(items)}
    assert got == {p: n for p, n in best.items() if n <= int(0.2 * len(items[p[1]][1]) + 1e-9)}
    assert len(got) >= 2 * len(items)


def test_parts_of_items_are_not_verified_one_by_one(monkeypatch):
    rnd = random.Random(17)
    items = [(k, leaks.reduced(words(rnd, 40).encode())) for k in range(12)]
    docs = []
    for k, (_, t) in enumerate(items):
        docs += [leaks.reduced(words(rnd, 60).encode()) + t[at : at + 70] + leaks.reduced(words(rnd, 60).encode()) for at in range(0, len(t) - 70, 30)]
        docs.append(leaks.reduced(edited(rnd, t.decode(), 0.15).encode()))
    index = leaks.Index(items)
    verified, distance = [], leaks.best_distance
    best = {(d, k): distance(t, text)[0] for d, text in enumerate(docs) for k, (_, t) in enumerate(items)}
    want = {p: n for p, n in best.items() if n <= index.allowed[p[1]]}
    monkeypatch.setattr(leaks, "best_distance", lambda item, text: verified.append(item) or distance(item, text))
    assert {(d, k): n for d, k, _, _, n in index.search(docs, index._filters())} == want
    assert len(want) < len(docs) / 4 and len(verified) <= 2 * len(want) + leaks.FEW


def test_items_of_very_short_pieces_are_verified_everywhere():
    item = b"a sentence of some length that may be edited in more than half of all its letters"
    index = leaks.Index([(1, item)], similarity=0.4)
    text = b"x" * 50 + bytes(c if i % 2 else 35 for i, c in enumerate(item)) + b"y" * 50
    assert index.pieces.everywhere == [0]
    assert [(d, k, n) for d, k, _, _, n in index.search([b"", text], index._filters())] == [(1, 0, leaks.best_distance(item, text)[0])]

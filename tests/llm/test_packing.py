import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siltworks.llm import packing
from siltworks.llm.packing import pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(runs):
    """Every single piece as (length, number) -> (sequence, offset)."""
    out = {}
    for r in runs:
        for k in range(r.count):
            assert (r.length, r.number + k) not in out
            out[r.length, r.number + k] = (r.sequence + k // r.each, r.offset + k % r.each * r.length)
    return out


def best_fit(sizes, capacity):
    """Pieces one by one, longest first, each where the least room is left."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=300, deadline=None)
def test_plan_is_gapless_and_as_good_as_best_fit(sizes):
    histogram = defaultdict(int)
    for s in sizes:
        histogram[s] += 1
    runs, sequences = plan(histogram, 30)
    places = laid_out(runs)
    assert len(places) == len(sizes)
    by = defaultdict(list)
    for (length, _), (sequence, offset) in places.items():
        by[sequence].append((offset, length))
    assert sorted(by) == list(range(sequences))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 30
        assert sum(3 * length > 30 for _, length in held) <= 2
    assert sequences <= best_fit(sizes, 30)


def test_large_pieces_are_matched_best():
    def most_pairs(sizes):
        if not sizes:
            return 0
        rest = sizes[1:]
        return max([most_pairs(rest)] + [1 + most_pairs(rest[:k] + rest[k + 1 :]) for k, s in enumerate(rest) if s + sizes[0] <= 30])

    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = [int(s) for s in rng.integers(11, 22, 9)]
        histogram = defaultdict(int)
        for s in sizes:
            histogram[s] += 1
        assert plan(histogram, 30)[1] == len(sizes) - most_pairs(sizes)


def test_steps_follow_lengths_not_pieces():
    runs, sequences = plan({s: 10**9 + s for s in range(1, 2049)})
    assert len(runs) < 20_000
    total = sum(s * (10**9 + s) for s in range(1, 2049))
    assert sequences <= 1.01 * total / 2048


def checked(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want.append((doc, k, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_awkward_rows(awkward, capacity):
    pairs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    rows = pack(awkward, PATH, capacity).collect()
    assert checked(rows, pairs, capacity) <= best_fit([r.length for r in rows], capacity)


def test_odd_characters_and_special_strings(documents):
    marks = ["a\x1cb", "a b", "x<|endoftext|>y", "<|startoftext|> it's", "I'LL ́e", "ΑΣ ΣΑΣ.", "İx", " ", "  a \t\r\n b\x0bc\x85d", "é̀ ̀"]
    pairs = list(enumerate([*marks, " ".join(marks), "\n".join(marks)]))
    checked(pack(documents(pairs), PATH, 8).collect(), pairs, 8)


def test_long_texts_are_read_in_parts(documents, monkeypatch):
    pairs = [(1, "some words of a text " * 400), (2, "x" * 3000 + " y"), (3, "\n \t")]
    known = packing.word_ids(PATH)
    whole = [list(x) for x in packing.encode(known, [t for _, t in pairs])]
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    monkeypatch.setattr(packing, "SEEN", 40)
    assert [list(x) for x in packing.encode(known, [t for _, t in pairs])] == whole


def test_words_are_split_as_the_library_splits_them():
    known, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    odd = [chr(c) for c in range(0x21, 0x250)] + ["ΑΣ", "Σ", "\u212a", "\u0958", "e\u0301", "İ", "ǅ", "ŉ"]
    texts = [f"{c}, a{c}b! {c}### It{c}s 'S{c}' <|endoftext|>{c}. {c}9-Ab?! {c * 3}_{c}" for c in odd]
    assert [list(x) for x in packing.encode(known, texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_the_library_is_not_called_word_by_word():
    class Counted:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **options)

    known = packing.WordIds(PATH)
    known.library = counted = Counted(known.library)
    made = [f"{a}{b}{c}" for a in "klmnoprstä" for b in "aeiouáéíóú" for c in "bdfgjvwxyz"]
    texts = [" ".join(w + m for w in made) for m in ("", ",", "###", "?!")]
    whole = [list(x) for x in packing.encode(known, texts)]
    assert counted.texts <= 10
    assert whole == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_empty_table(nothing):
    assert pack(nothing, PATH).collect() == []

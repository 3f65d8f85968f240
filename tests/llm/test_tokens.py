import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from siltworks.llm import bpe, tokens

COUNT_PATH = public_tokenizers.path("byte_bpe_50k.json")
RANK_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    letters = [chr(c) for c in range(0x300)] + [chr(c) for c in (0x1680, 0x2028, 0x3000, 0x200B, 0x1F600, 0x4E00, 0x661, 0xBD, 0x903, 0xFEFF)]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    out += ["".join(rnd.choice("aab \n\t<|endoftext|>'s xyz 123") for _ in range(rnd.randint(0, 150))) for _ in range(200)]
    return out + ["<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>\n", "", "a" * 5000, " " * 70_000 + "x", "ab" * 900 + "xyz" * 99]


def test_counts_are_the_library_s(odd_texts):
    known = Tokenizer.from_file(COUNT_PATH)
    want = [len(e.ids) for e in known.encode_batch(odd_texts, add_special_tokens=False)]
    assert tokens.count_tokens(COUNT_PATH, PATTERN)(odd_texts) == want


def test_count_rows(awkward):
    got = tokens.token_counts(awkward, COUNT_PATH, PATTERN).collect()
    known = Tokenizer.from_file(COUNT_PATH)
    want = [(r.doc_id, len((r.text or "").encode()), len(known.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_forgetting_changes_nothing(odd_texts, monkeypatch):
    want = tokens.count_tokens(COUNT_PATH, PATTERN)(odd_texts)
    monkeypatch.setattr(tokens, "SEEN", 10)
    count = tokens.count_tokens(COUNT_PATH, PATTERN)
    assert [count([t])[0] for t in odd_texts] == want


def encoding():
    with open(RANK_PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(odd_texts):
    codec, known = bpe.Codec(RANK_PATH, PATTERN), encoding()
    for text in odd_texts:
        ids = [i for part in codec.encode(text) for i in part]
        assert ids == known.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_digest_rows(awkward):
    known = encoding()
    want = []
    for r in awkward.collect():
        ids = known.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(awkward, RANK_PATH, PATTERN).collect()), key=repr) == sorted(want, key=repr)


def test_encode_then_decode(awkward, nothing):
    back = bpe.decode(bpe.encode(awkward, RANK_PATH, PATTERN), RANK_PATH, PATTERN).collect()
    assert sorted((repr(r.doc_id), bytes(r.text)) for r in back) == sorted((repr(r.doc_id), (r.text or "").encode()) for r in awkward.collect())
    assert all(r.whole for r in bpe.round_trip(awkward, RANK_PATH, PATTERN).collect())
    assert bpe.digests(nothing, RANK_PATH, PATTERN).count() == tokens.token_counts(nothing, COUNT_PATH, PATTERN).count() == 0

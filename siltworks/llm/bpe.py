"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary.

The rank file is written out as a sentencepiece BPE model: each token's bytes become letters (one per byte, in a
range without white space), its score is the negative rank, so the best merge is the one of lowest rank, and the
normaliser is the identity. Pre-tokens are encoded as such letters; decoding maps ids back to bytes.

At scale: narrow maps, no shuffle. A task holds the model and the ids of pre-tokens it has seen, up to ``SEEN``
characters. The model is made once per Python worker and never written.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from siltworks.llm.common import slices, texts

LETTER = 0x100  # byte b is written as the letter LETTER + b
SEEN = 5_000_000
AT_ONCE = 1 << 16
# fixed values of the model format: field numbers, model type BPE, piece type UNKNOWN
PIECE, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BPE, UNKNOWN = 3, 2, 2
UNK_ID, BOS_ID, EOS_ID, PAD_ID = 40, 41, 42, 43
DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _letters(raw: bytes) -> str:
    return "".join([chr(LETTER + b) for b in raw])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks (which must run from 0 without gaps)."""
    parts = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        score = struct.pack("<f", -float(rank))
        parts.append(_bytes(PIECE, _bytes(1, _letters(token).encode()) + _varint(2 << 3 | 5) + score))
    parts.append(_bytes(PIECE, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    trainer = _number(MODEL_TYPE, BPE) + _number(UNK_ID, len(ranks))
    trainer += b"".join(_number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join(parts) + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, normalizer)


def _ids(*numbers: int) -> bytes:
    return array("i", numbers).tobytes()


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.table = str.maketrans({chr(b): chr(LETTER + b) for b in range(256)})
        self.bytes = [b for b, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.seen: dict[str, bytes] = {}  # ids as 32-bit numbers, a fifth of the size of lists
        self.held = 0

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.seen))
        if self.held > SEEN:
            self.seen.clear()
            self.held, new = 0, list(words)
        whole, rest = [], []
        for w in new:
            (whole if w.encode() in self.ranks else rest).append(w)
        # a pre-token that is a token as it stands needs no merges
        self.seen.update((w, _ids(self.ranks[w.encode()])) for w in whole)
        letters = [w.encode().decode("latin-1").translate(self.table) for w in rest]
        if rest:
            self.seen.update((w, _ids(*ids)) for w, ids in zip(rest, self.model.encode(letters, num_threads=1), strict=True))
        self.held += sum(map(len, new))

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, in arrays of a bounded number of pre-tokens."""
        found = (m.group() for m in self.find.finditer(text)) if len(text) > AT_ONCE else iter(self.find.findall(text))
        while words := list(islice(found, AT_ONCE)):
            self._learn(set(words))
            yield np.frombuffer(b"".join(map(self.seen.__getitem__, words)), dtype=np.int32)

    def prepare(self, batch: list[str]) -> None:
        """Encode the new pre-tokens of all short texts of a batch in one call."""
        self._learn({w for t in batch if len(t) <= AT_ONCE for w in self.find.findall(t)})

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _whole(own: Codec, text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int32), *own.encode(text)])


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int). NULL and empty texts have no ids; repeated rows and rows
    without doc_id are encoded like any other; other columns are ignored."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 64):
            found = [_whole(own, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Inverse of :func:`encode`: doc_id, text (binary, as ids need not end at a character)."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 64):
            raw = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids and whole (decoding gives the text back). Cases as in
    :func:`encode`."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 64):
            column = batch.column(1).to_pylist()
            own.prepare(column)
            found = [_whole(own, t) for t in column]
            whole = [own.decode(ids) == t.encode() for ids, t in zip(found, column, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, found)), pa.int64()), _lists(found), pa.array(whole, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "whole"],
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, whole boolean")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256, each lower-case hex. Cases as in :func:`encode`; ids of a long text are digested in parts."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches):
            counts, id_sums, raw_sums = [], [], []
            column = batch.column(1).to_pylist()
            own.prepare(column)
            for text in column:
                n, ids_sum, raw_sum = 0, hashlib.sha256(), hashlib.sha256()
                for ids in own.encode(text):
                    ids_sum.update((("," if n else "") + ",".join(map(str, ids.tolist()))).encode())
                    raw_sum.update(own.decode(ids))
                    n += len(ids)
                counts.append(n)
                id_sums.append(ids_sum.hexdigest())
                raw_sums.append(raw_sum.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(raw_sums)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie behind each other in one numpy array (ragged, with the sequence of each symbol).
In every round each sequence merges its own lowest-ranked adjacent pair at all places, all sequences at once,
until no pair of any sequence has a rank. The symbols that survive are the tokens.

At scale: a narrow map over the documents, no shuffle. A task holds the vocabulary, one slice of documents and
the counts of pre-tokens it has seen, which are forgotten beyond ``SEEN`` characters.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import slices, texts

LIMIT = 1024
SEEN = 24_000_000
AT_ONCE = 1 << 16  # pre-tokens of one text that are held at a time
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the
    others numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merger:
    """Merge table of a byte-level tokenizer file (.json) and the arrays to apply it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        vocab = known["model"]["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in known["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        out = lengths.copy()
        while len(symbols) > 1:
            together = owner[:-1] == owner[1:]
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(together & (self.keys[at] == pair), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            hit = (rank != NO_RANK) & (rank == np.repeat(least, sizes)[:-1])
            if not hit.any():
                break
            where = np.flatnonzero(hit)
            # of pairs that overlap (x x x), every second one from the left is merged
            fresh = np.r_[True, np.diff(where) != 1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            out -= np.bincount(owner[where], minlength=n)
            stay = np.ones(len(symbols), dtype=bool)
            stay[where + 1] = False
            stay &= np.repeat(least != NO_RANK, sizes)  # sequences without a ranked pair are finished
            symbols, owner = symbols[stay], owner[stay]
        return out


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(path: str, pattern: str) -> "callable":
    """Function from a list of texts to their token counts."""
    known, find = merger(path), regex.compile(pattern)
    seen: dict[str, int] = {}
    held = 0

    def parts(text: str) -> Iterator[list[str]]:
        plain = known.split.split(text) if known.split else [text]
        for piece in plain:
            words = (m.group() for m in find.finditer(piece)) if len(piece) > AT_ONCE else iter(find.findall(piece))
            while some := list(islice(words, AT_ONCE)):
                yield some

    def add(words: list[str]) -> int:
        nonlocal held
        new = list(set(words).difference(seen))
        if new:
            if held > SEEN:
                seen.clear()
                held = 0
                new = list(set(words))
            seen.update(zip(new, known.counts([w.encode() for w in new]).tolist(), strict=True))
            held += sum(map(len, new))
        return sum(map(seen.__getitem__, words))

    def run(batch: list[str]) -> list[int]:
        out = [len(known.split.findall(t)) if known.split else 0 for t in batch]
        short = [[w for p in (known.split.split(t) if known.split else [t]) for w in find.findall(p)] if len(t) <= AT_ONCE else None for t in batch]
        fresh = set().union(*(s for s in short if s)) if any(short) else set()
        add(list(fresh))  # one round of merging for all short texts
        for k, (text, words) in enumerate(zip(batch, short, strict=True)):
            out[k] += add(words) if words is not None else sum(map(add, parts(text)))
        return out

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level tokenizer file (.json), which every executor can open; ``pattern`` splits a text into
    pre-tokens. Strings of special tokens inside a text count as one token each, as the library has it by default.
    NULL texts count as empty (0 bytes, 0 tokens), repeated rows and rows without doc_id are counted like any other.
    """

    def run(batches):
        count = count_tokens(path, pattern)
        for batch in slices(batches):
            numbers = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    source = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = source.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts are lower-cased and reduced to letters, digits and single spaces. The CGK walk reads a string and writes one
symbol per step; whether it moves on is decided by a random bit for (step, symbol). Two strings that walk with the
same bits fall into step again soon after an edit, so few edits become few differing symbols (edit distance becomes Hamming
distance). A table of the LSH hashes the symbols at sampled steps; ``repeats`` tables, each with walk bits and sampled
steps of its own, are made so that an item with ``edits`` edits is found with the target recall.

The tables find what is copied with few edits; the rest up to the threshold is found by pieces, exactly. An item that may have
k edits is cut into (k + 1) / 2 pieces (rounded up), so that one of them has one edit at most wherever the item matches. The
documents are looked up at every place among all strings within one edit of a piece, and what is hit must also hold in groups of
2, 4, ... neighbouring pieces with the edits that these may share, before the whole item is verified.

Items of ``SHORT`` to ``BRIEF`` characters have no room for walks. They are found by exact counting: an item of n characters
with k edits keeps n - q + 1 - k * q of its q-grams, at places that are at most k apart from the item's start.

Documents are read at windows on a grid, whose step is a third of the shortest embedded item, so every embedded item holds
windows wholly inside it. Items are indexed at every offset; a hit says which item would start where. There
the item-sized stretch of the document is verified: the smallest edit distance of the item to any part of
it, by bit-parallel dynamic programming. Only verified matches are returned, so nothing clean is reported.

At scale: a narrow map over the documents, no shuffle of text. The index is made from the benchmark alone, in
chunks of at most ``CHUNK`` characters that are broadcast one after the other (a benchmark of any size is taken in
blocks; its rows are read to the driver chunk by chunk). Matches are one small row per document and item.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import slices, texts
from siltworks.sources.scratch import cut

SIMILARITY = 0.8  # at most a fifth of an item's characters may be edited
EDITS = 0.08  # share of edited characters for which the tables are laid out
RECALL = 0.95
STEPS = 64
SAMPLED = 12
LEAST, MOST = 4, 12  # tables
CHUNK = 1 << 17  # characters of items indexed at a time
AT_ONCE = 1 << 21  # characters of documents searched at a time
SHORT = 24  # items of fewer characters are looked for as they are
BRIEF = 48  # items of fewer characters are not embedded: their q-grams are counted
GRAM = 4
AT_A_TIME = 1 << 14  # characters whose q-grams are counted at a time
PAD = 32  # the symbol behind the end
PIECE = 9  # characters of a piece that are looked up, at most
LEAST_PIECE = 4  # items whose pieces are shorter are verified everywhere
WORD = 64  # characters of a group of pieces, at most
PLACES = 1 << 14  # places of documents looked up at a time
MARKS = 22  # bits of the marks of strings
KNOWN = 25  # bits of the marks that tell whether a string is known
FEW = 32  # guesses that are verified without a look at their blocks

_KEEP = np.full(256, PAD, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b).lower()
    if _b >= 128 or _c.isalnum():
        _KEEP[_b] = ord(_c) if _b < 128 else _b

# 32 classes of symbols: texts within some edits are within as many of them by class
_CLASS = np.array([b - 96 if 97 <= b <= 122 else 0 if b == 32 else 27 + b % 5 for b in range(256)], dtype=np.uint64)


def reduced(raw: bytes) -> bytes:
    """ASCII letters lower-cased, bytes of other characters kept, everything else one space."""
    return b" ".join(_KEEP[np.frombuffer(raw, dtype=np.uint8)].tobytes().split())


@dataclass(frozen=True)
class Walks:
    """Random bits and sampled steps of every table."""

    bits: np.ndarray  # tables x steps x 256
    steps: tuple[tuple[int, ...], ...]

    @classmethod
    def make(cls, tables: int, steps: int = STEPS, sampled: int = SAMPLED, seed: int = 11) -> "Walks":
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (tables, steps, 256), dtype=np.uint8)
        return cls(bits, tuple(tuple(sorted(rng.choice(steps, sampled, replace=False).tolist())) for _ in range(tables)))

    def hashes(self, buffer: np.ndarray, at: np.ndarray, table: int) -> np.ndarray:
        """64-bit hash of the sampled symbols of the walk that begins at each position. ``buffer`` ends in STEPS pads."""
        place = at.astype(np.int64)
        out = np.zeros(len(at), dtype=np.uint64)
        wanted = set(self.steps[table])
        for step in range(max(self.steps[table]) + 1):
            symbol = np.take(buffer, place, mode="clip")
            if step in wanted:
                out = (out ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            place += np.take(self.bits[table, step], symbol, mode="clip")
        return out


def best_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """(smallest edit distance of ``item`` to any part of ``text``, where that part ends), bit-parallel."""
    m = len(item)
    peq: dict[int, int] = {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text):
        x = peq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        score += bool(hp & top) - bool(hn & top)
        # a part may begin anywhere: nothing is carried into the first row
        hp = hp << 1 & full
        vn = hp & d0
        vp = (hn << 1 | ~(hp | d0)) & full
        if score < best:
            best, end = score, at + 1
    return best, end


def collision(items: list[bytes], share: float, windows: int, rng: np.random.Generator) -> float:
    """Estimated chance that one table finds an item of which ``share`` of the characters were edited, when the
    document shows ``windows`` of its places."""
    walks = Walks.make(1)
    hit = total = 0
    for item in (items * 200)[:200]:
        edited = bytearray()
        for c in item:
            r = rng.random()
            if r < share / 3:
                continue
            edited.append(int(rng.integers(97, 123)) if r < 2 * share / 3 else c)
            if 2 * share / 3 <= r < share:
                edited.append(int(rng.integers(97, 123)))
        a = np.r_[np.frombuffer(item, dtype=np.uint8), np.full(STEPS, PAD, np.uint8)]
        b = np.r_[np.frombuffer(bytes(edited), dtype=np.uint8), np.full(STEPS, PAD, np.uint8)]
        known = np.unique(walks.hashes(a, np.arange(len(item)), 0))
        step = max(1, len(edited) // windows)
        hit += bool(np.isin(walks.hashes(b, np.arange(0, max(1, len(edited) - step), step), 0), known).any())
        total += 1
    return hit / max(1, total)


def repeats_for(items: list[bytes], stride: int, share: float = EDITS, recall: float = RECALL) -> int:
    """Tables needed for the recall, between LEAST and MOST."""
    windows = max(1, sorted(map(len, items))[len(items) // 2] // stride)
    p = collision(items, share, windows, np.random.default_rng(5))
    if p >= recall:
        return LEAST
    return MOST if p <= 0 else max(LEAST, min(MOST, math.ceil(math.log(1 - recall) / math.log(1 - p))))


def within_one(codes: np.ndarray, size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, codes, which) of the strings within one edit of strings of ``size`` classes, five bits each. An edit before the
    first or behind the last symbol is seen as none or as another symbol there, one place on."""
    which = np.arange(len(codes))
    out = [(size, codes, which)]
    for j in range(size):
        at = np.uint64(5 * j)
        low, high = codes & ((np.uint64(1) << at) - np.uint64(1)), codes >> at
        for c in range(32):
            symbol = np.uint64(c) << at
            out.append((size, low | symbol | high >> np.uint64(5) << at + np.uint64(5), which))
            if j:
                out.append((size + 1, low | symbol | high << at + np.uint64(5), which))
        if 0 < j < size - 1:
            out.append((size - 1, low | high >> np.uint64(5) << at, which))
    return out


def _codes(symbols: np.ndarray, size: int) -> np.ndarray:
    """The next ``size`` classes from each place on, five bits each."""
    if size == 1:
        return symbols
    half = _codes(symbols, (size + 1) // 2)
    step = size // 2
    return half[:-step] | half[step:] << np.uint64(5 * step)


def _set(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the bits are set in a bitmap."""
    found = np.take(packed, bits >> 3, mode="clip")
    found >>= bits.astype(np.uint8) & 7
    return np.flatnonzero(found & 1)


class Pieces:
    """The pieces of items, all strings within one edit of them, and the groups of pieces that a hit must hold in."""

    def __init__(self, items: list[tuple[int, bytes, int]]):
        self.everywhere: list[int] = []
        self.item, self.offset = [], []
        codes: dict[int, list[tuple[int, int]]] = {}
        patterns: list[tuple[bytes, int]] = []
        groups: list[list[tuple[int, int]]] = []  # by piece: (pattern, its offset), from few pieces to many
        blocks = np.zeros((1 + max((k for k, _, _ in items), default=0), 2), dtype=np.int64)  # by item: first pattern, how many
        for k, text, allowed in items:
            n = allowed // 2 + 1
            ends = [len(text) * j // n for j in range(n + 1)]
            if len(text) // n < LEAST_PIECE:
                self.everywhere.append(k)
                continue
            first = len(self.item)
            for j in range(n):
                piece = text[ends[j] : ends[j + 1]][:PIECE]
                codes.setdefault(len(piece), []).append((sum(int(_CLASS[b]) << 5 * i for i, b in enumerate(piece)), first + j))
                self.item.append(k)
                self.offset.append(ends[j])
                groups.append([])
            # blocks of the whole item: what they are short of adds up
            cuts = range(0, len(text), -(-len(text) // -(-len(text) // WORD)))
            blocks[k] = (len(patterns), len(cuts))
            patterns += [(text[c : c + cuts.step], 0) for c in cuts]
            size = 1
            while size < 2 * n:
                for j in range(0, n, size):
                    last = min(n, j + size)
                    if size > 1 and last - j <= size // 2:  # one group of the level before, again
                        for one in range(first + j, first + last):
                            groups[one].append(groups[one][-1])
                    elif ends[last] - ends[j] <= WORD:
                        patterns.append((text[ends[j] : ends[last]], 2 * (last - j) - 1))
                        for one in range(first + j, first + last):
                            groups[one].append((len(patterns) - 1, ends[j]))
                size *= 2
        self.blocks = blocks
        self.item, self.offset = np.array(self.item, dtype=np.int64), np.array(self.offset, dtype=np.int64)
        self.edits = np.array([e for _, e in patterns], dtype=np.int64)
        self.sizes = np.array([len(t) for t, _ in patterns], dtype=np.int64)
        self.peq = np.zeros((len(patterns), 32), dtype=np.uint64)
        for p, (text, _) in enumerate(patterns):
            for i, b in enumerate(text):
                self.peq[p, int(_CLASS[b])] |= np.uint64(1 << i)
        levels = max(map(len, groups), default=0)
        # the first group is the piece by itself; a piece without a further group keeps its last one
        self.groups = [np.array([g[min(level, len(g) - 1)] for g in groups], dtype=np.int64) for level in range(1, levels)]
        parts = []
        for size, some in codes.items():
            ids = np.array([i for _, i in some], dtype=np.int64)
            for length, strings, which in within_one(np.array([c for c, _ in some], dtype=np.uint64), size):
                parts.append((strings << np.uint64(4) | np.uint64(length), ids[which].astype(np.int32)))
        self.lengths = sorted({n + e for n in codes for e in (-1, 0, 1)})
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
        ids = np.concatenate([np.zeros(0, np.int32), *(i for _, i in parts)])
        order = np.lexsort((ids, keys, self._mark(keys)))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        self.keys, self.ids = keys[new], ids[new]

    @staticmethod
    def _mark(keys: np.ndarray, bits: int = MARKS) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of the first symbols of the known strings, as many as the shortest has, and of whole strings; and where the
        strings of a mark begin."""
        # of bits, not bytes: many workers share a cache
        seen, known = np.zeros(1 << MARKS, dtype=bool), np.zeros(1 << KNOWN, dtype=bool)
        seen[self._mark(self.keys >> np.uint64(4) & np.uint64((1 << 5 * self.lengths[0]) - 1))] = True
        known[self._mark(self.keys, KNOWN)] = True
        starts = np.searchsorted(self._mark(self.keys), np.arange((1 << MARKS) + 1)).astype(np.int32)
        return np.packbits(seen, bitorder="little"), np.packbits(known, bitorder="little"), starts

    def hits(self, buffer: np.ndarray, marks: tuple[np.ndarray, np.ndarray]):
        """(place of the piece in ``buffer``, piece), by arrays, where every group holds. ``buffer`` begins and ends in pads."""
        symbols = _CLASS[buffer]
        shortest, longest = self.lengths[0], self.lengths[-1]
        seen, known, starts = marks
        held, rows, left_over = [], 0, []
        for begin in range(0, len(buffer) - longest + 1, PLACES):
            some = symbols[begin : begin + PLACES + longest - 1]
            whole = _codes(some, shortest)[: len(some) - longest + 1]
            at = _set(seen, self._mark(whole))
            code = whole[at]
            for length in range(shortest, longest + 1):
                if length > shortest:
                    code |= some[at + length - 1] << np.uint64(5 * (length - 1))
                if length in self.lengths:
                    keys = code << np.uint64(4) | np.uint64(length)
                    there = _set(known, self._mark(keys, KNOWN))
                    keys = keys[there]
                    mark = self._mark(keys)
                    left = np.take(starts, mark, mode="clip").astype(np.int64)
                    count = np.take(starts, mark + 1, mode="clip") - left
                    total = np.cumsum(count)
                    which = np.repeat(np.arange(len(count)), count)
                    entry = np.arange(len(which)) + np.repeat(left - total + count, count)
                    same = np.flatnonzero(np.take(self.keys, entry, mode="clip") == np.take(keys, which, mode="clip"))
                    held.append((at[there[which[same]]] + begin, self.ids[entry[same]].astype(np.int64)))
                    rows += len(held[-1][0])
            ends = begin + PLACES >= len(buffer) - longest + 1
            if rows >= PLACES or ends:
                left_over.extend(self._within(symbols, *(np.concatenate(x) for x in zip(*held, strict=True)), self.groups[:1]))
                held, rows = [], 0
            # few hold in the first group: the others are looked at for many places at a time
            if left_over and (ends or sum(len(p) for p, _ in left_over) >= PLACES):
                yield from self._within(symbols, *(np.concatenate(x) for x in zip(*left_over, strict=True)), self.groups[1:])
                left_over = []

    def _within(self, symbols: np.ndarray, place: np.ndarray, piece: np.ndarray, groups: list[np.ndarray]):
        """(place, piece), by arrays, where the groups hold."""
        for i in range(0, len(place), PLACES):
            p, q = place[i : i + PLACES], piece[i : i + PLACES]
            for group in groups:
                near = self._held(symbols, p, q, group)
                p, q = p[near], q[near]
            if len(p):
                yield p, q

    def _held(self, symbols: np.ndarray, place: np.ndarray, piece: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether the group of each piece is near its place within its edits: ``best_distance`` of many at once, by class."""
        pattern, offset = group[piece, 0], group[piece, 1]
        edits, size = self.edits[pattern], self.sizes[pattern]
        at = place - (self.offset[piece] - offset) - edits
        return self._least(symbols, at, pattern, int((size + 2 * edits).max(initial=0))) <= edits

    def _least(self, symbols: np.ndarray, at: np.ndarray, pattern: np.ndarray, steps: int) -> np.ndarray:
        """The smallest distance of each pattern to any part of the ``steps`` symbols from its place on, by class."""
        size = self.sizes[pattern]
        kind = np.uint32 if size.max(initial=0) <= 32 else np.uint64
        peq, row = self.peq.ravel().astype(kind), pattern * 32
        one, top = kind(1), (size - 1).astype(kind)
        vp, vn = np.full(len(at), ~kind(0)), np.zeros(len(at), dtype=kind)
        signed = np.int32 if kind is np.uint32 else np.int64
        score = size.astype(signed)
        best = score.copy()
        for step in range(steps):
            x = np.take(peq, row + np.take(symbols, at + step, mode="clip").view(np.int64), mode="clip") | vn
            d0 = ((vp + (x & vp)) ^ vp) | x
            hn = vp & d0
            hp = vn | ~(vp | d0)
            score += (hp >> top & one).view(signed)
            score -= (hn >> top & one).view(signed)
            hp <<= one
            vn = hp & d0
            vp = (hn << one) | ~(hp | d0)
            np.minimum(best, score, out=best)
        return best

    def near(self, buffer: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether the blocks of each item can be near the places from ``low`` to ``high`` of ``buffer`` within the allowed edits:
        together they are no further from a part of it than the item. Never wrong about what is near."""
        out = np.ones(len(item), dtype=bool)
        symbols = _CLASS[buffer]
        order = np.argsort(high - low, kind="stable")  # of like lengths together
        total = np.cumsum(self.blocks[item[order], 1])
        begin = 0
        while len(order) - begin >= FEW:
            upto = max(begin + FEW, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES, "right")))
            some = order[begin:upto]
            first, count = self.blocks[item[some]].T
            which = np.repeat(np.arange(len(some)), count)
            pattern = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(which))
            least = self._least(symbols, low[some][which], pattern, int((high - low)[some].max()))
            out[some] = np.bincount(which, least, len(some)) <= allowed[some]
            begin = upto
        return out


class Index:
    """Hashes of all items at all offsets, the pieces of the items, and the verification of hits."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY):
        self.items = items
        self.allowed = [int((1 - similarity) * len(t) + 1e-9) for _, t in items]
        self.edits = np.array(self.allowed, dtype=np.int64)
        long = [(k, t) for k, (_, t) in enumerate(items) if len(t) >= BRIEF]
        self.short = [(k, t) for k, (_, t) in enumerate(items) if 0 < len(t) < SHORT]
        self.stride = max(1, min((len(t) for _, t in long), default=BRIEF) // 3)
        self._count_grams([(k, t) for k, (_, t) in enumerate(items) if SHORT <= len(t) < BRIEF])
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._made: list | None = None
        self.pieces = Pieces([(k, t, self.allowed[k]) for k, t in long])
        if not long:
            return
        self.walks = Walks.make(repeats_for([t for _, t in long], self.stride))
        parts = [np.r_[np.frombuffer(t, dtype=np.uint8), np.full(STEPS, PAD, np.uint8)] for _, t in long]
        buffer = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        # a window holds at least as many characters as the walk reads on average
        room = [max(1, len(t) - STEPS // 3) for _, t in long]
        at = np.concatenate([s + np.arange(n) for s, n in zip(starts, room, strict=True)])
        item = np.repeat([k for k, _ in long], room).astype(np.int32)
        offset = np.concatenate([np.arange(n) for n in room]).astype(np.int32)
        for table in range(len(self.walks.steps)):
            keys = self.walks.hashes(buffer, at, table)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], item[order], offset[order]))

    def _count_grams(self, brief: list[tuple[int, bytes]]) -> None:
        """The q-grams of the brief items, sorted, each with its item and offset; and how many of them an item keeps."""
        kept = lambda q: {k: len(t) - q + 1 - self.allowed[k] * q for k, t in brief}
        self.gram = next((q for q in range(GRAM, 1, -1) if min(kept(q).values(), default=1) >= 1), 1)
        self.kept = np.ones(len(self.items), dtype=np.int64)
        for k, n in kept(self.gram).items():
            self.kept[k] = max(1, n)
        # a match keeps to two neighbouring cells of so many starts
        self.cell = np.array(self.allowed, dtype=np.int64) + 1
        codes = np.concatenate([np.zeros(0, np.int64), *(self._codes(t) for _, t in brief)])
        order = np.argsort(codes, kind="stable")
        sizes = [len(t) - self.gram + 1 for _, t in brief]
        self.grams = codes[order]
        self.gram_item = np.repeat(np.array([k for k, _ in brief], dtype=np.int64), sizes)[order]
        self.gram_offset = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])[order]

    def _codes(self, text: bytes) -> np.ndarray:
        symbols = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
        n = max(0, len(symbols) - self.gram + 1)
        return sum((symbols[j : j + n] << 8 * j for j in range(self.gram)), np.zeros(n, np.int64))

    def _brief(self, text: bytes):
        """(item, first and last place to look at) wherever ``text`` holds enough q-grams of a brief item at about one start."""
        for begin in range(0, len(text), AT_A_TIME):
            codes = self._codes(text[begin : begin + AT_A_TIME + 2 * BRIEF])
            left, right = np.searchsorted(self.grams, codes, "left"), np.searchsorted(self.grams, codes, "right")
            count = right - left
            place = np.repeat(np.arange(len(codes)), count)
            at = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
            item = self.gram_item[at]
            cell = (begin + place - self.gram_offset[at] + BRIEF) // self.cell[item]
            span = len(text) + 2 * BRIEF + 2
            keys, found = np.unique(item * span + cell, return_counts=True)
            after = np.searchsorted(keys, keys + 1)
            follows = np.append(keys, -1)[after] == keys + 1
            total = found + np.where(follows, np.append(found, 0)[after], 0)
            for key in keys[total >= self.kept[keys // span]].tolist():
                k, c = divmod(key, span)
                size, edits = int(self.cell[k]), self.allowed[k]
                yield k, max(0, c * size - BRIEF - edits), (c + 2) * size - BRIEF + len(self.items[k][1]) + edits

    def _filters(self) -> list[np.ndarray]:
        """Of each table, and of the pieces behind them; made once for all tasks of a worker."""
        if self._made is None:
            self._made = self._make_filters()
        return self._made

    def _make_filters(self) -> list[np.ndarray]:
        out = []
        for keys, _, _ in self.tables:
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(keys >> np.uint64(42)).astype(np.int64)] = True
            out.append(seen)
        return [*out, self.pieces.marks()] if len(self.pieces.keys) else out

    def search(self, documents: list[bytes], filters: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, distance): the best match of each item in each of the reduced documents."""
        pad = np.full(STEPS, PAD, np.uint8)
        parts = [x for d in documents for x in (np.frombuffer(d, dtype=np.uint8), pad)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.tables and parts:
            buffer = np.concatenate(parts)
            sizes = np.array([len(d) for d in documents])
            starts = np.cumsum(np.r_[0, sizes[:-1] + STEPS])
            grid = np.concatenate([s + np.arange(0, max(1, n), self.stride) for s, n in zip(starts, sizes, strict=True)])
            guesses: set[tuple[int, int, int]] = set()
            for table, (keys, item, offset) in enumerate(self.tables):
                found = self.walks.hashes(buffer, grid, table)
                some = np.flatnonzero(filters[table][(found >> np.uint64(42)).astype(np.int64)])
                left = np.searchsorted(keys, found[some], "left")
                right = np.searchsorted(keys, found[some], "right")
                for g, a, b in zip(grid[some].tolist(), left.tolist(), right.tolist(), strict=True):
                    if a < b:
                        d = int(np.searchsorted(starts, g, "right")) - 1
                        # offsets of one item that hash alike say the same place within the slack below
                        guesses.update((d, int(k), (g - int(starts[d]) - int(o)) // 16) for k, o in zip(item[a:b], offset[a:b], strict=True))
            if len(self.pieces.keys):
                for place, piece in self.pieces.hits(np.concatenate([pad, buffer]), filters[-1]):
                    place = place - STEPS
                    which = np.maximum(np.searchsorted(starts, place, "right") - 1, 0)
                    near = (place - starts[which] - self.pieces.offset[piece]) // 16
                    guesses.update(zip(which.tolist(), self.pieces.item[piece].tolist(), near.tolist(), strict=True))
            runs: list[tuple[int, int, int, int]] = []
            ahead = iter([*sorted(guesses), None])
            run = next(ahead)
            while run is not None:  # neighbouring guesses are verified at once
                (d, k, first), last = run, run[2]
                while (run := next(ahead)) is not None and run[:2] == (d, k) and run[2] <= last + 2:
                    last = run[2]
                slack = self.allowed[k] + 16
                runs.append((d, k, max(0, first * 16 - slack), max(0, last * 16 + len(self.items[k][1]) + slack)))
            if runs:
                which, item, low, high = np.array(runs, dtype=np.int64).T
                near = self.pieces.near(buffer, item, starts[which] + low, starts[which] + high, self.edits[item])
                for i in np.flatnonzero(near).tolist():
                    self._verify(*runs[i], documents[runs[i][0]], best)
            for k in self.pieces.everywhere:
                for d, text in enumerate(documents):
                    self._verify(d, k, 0, len(text), text, best)
        if len(self.grams):
            for d, text in enumerate(documents):
                for k, low, high in self._brief(text):
                    self._verify(d, k, low, high, text, best)
        for d, text in enumerate(documents):
            for k, item in self.short:
                at = f" {text.decode('latin-1')} ".find(f" {item.decode('latin-1')} ")
                if at >= 0:
                    best[d, k] = (0, at, at + len(item))
        return [(d, k, start, end, distance) for (d, k), (distance, start, end) in best.items()]

    def _verify(self, d: int, k: int, low: int, high: int, text: bytes, best: dict) -> None:
        item = self.items[k][1]
        if (d, k) in best and best[d, k][0] == 0:
            return
        distance, end = best_distance(item, text[low:high])
        if distance <= self.allowed[k] and distance < best.get((d, k), (math.inf,))[0]:
            best[d, k] = (distance, max(low, low + end - len(item)), low + end)


def _chunks(benchmark: DataFrame, chunk: int):
    """Items (id, reduced text) in chunks of at most ``chunk`` characters (one item at least)."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    held, some = 0, []
    for row in rows.filter(F.col("text").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator():
        text = reduced(row["text"].encode())
        if some and held + len(text) > chunk:
            yield some
            held, some = 0, []
        some.append((row["item_id"], text))
        held += len(text)
    if some:
        yield some


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start, end, distance, item_chars.

    start and end are bytes of the reduced text (start is exact up to the edits), distance is the edit distance of the best
    match, at most ``1 - similarity`` of the item's characters. Items of fewer than ``SHORT`` characters must occur word
    for word; empty items and NULL texts never match. A repeated document gives its rows again; a repeated item
    once; rows without doc_id or item_id carry NULL. Without documents or items the result is empty. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, start bigint, `end` bigint, distance int, item_chars int"
    names = ["doc_id", "item_id", "start", "end", "distance", "item_chars"]
    source = texts(docs)

    def searched(items):
        shared = spark.sparkContext.broadcast(Index(items, similarity))  # bounded by ``chunk``

        def run(batches):
            index = shared.value
            filters = index._filters()

            def emit(ids, held):
                hits = index.search(held, filters)
                rows = [(ids[d], index.items[k][0], s, e, n, len(index.items[k][1])) for d, k, s, e, n in hits]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

            ids, held, size = [], [], 0
            for batch in slices(batches):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    held.append(reduced(t.encode()))
                    size += len(held[-1])
                    if size >= AT_ONCE:
                        yield emit(ids, held)
                        ids, held, size = [], [], 0
            if held:
                yield emit(ids, held)

        return source.mapInArrow(run, schema)

    found = None
    for items in _chunks(benchmark, chunk):
        part = searched(items)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without the documents that hold a benchmark item. Rows without doc_id stay
    (they cannot be named as leaking). Starts jobs."""
    found = cut(find_leaks(docs, benchmark, similarity).select("doc_id").distinct(), "leaks")
    gone = found.df.select(F.col("doc_id").alias("_leak"))
    # by frame: a document column may have the same name
    return docs.join(F.broadcast(gone) if found.small else gone, docs["doc_id"].cast("bigint") == gone["_leak"], "left_anti")

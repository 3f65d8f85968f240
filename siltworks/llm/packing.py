"""Best-fit packing of token sequences by large-item matching.

A document is its token ids and one end id. Documents longer than a sequence are cut into whole sequences and a rest.
Pieces above a third of the capacity go at most two to a sequence: from the longest on, each is matched with the longest
other one that still fits. Smaller pieces follow by size and go where the least room is left.

At scale: which piece stands where depends on its length and on its number among the pieces of that length only. Tasks
tokenize, number the pieces of each length and store them (no text is shuffled); the counts of a task and a length are
summed over tasks. The plan is made from the histogram of lengths, which has ``capacity`` entries at any size of the
table, and lists runs of like sequences; tasks then look up each piece's run. A length that a third of all pieces
share is one entry of the histogram, and its pieces stay spread over all tasks.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.llm.common import slices, stored, texts
from siltworks.sources.scratch import cut

CAPACITY = 2048
END_ID = 0
SEEN = 16_000_000  # characters of words whose ids a task remembers
AT_ONCE = 1 << 20  # characters of one text that are split at a time
JOINED = 1000  # words of letters that the tokenizer gets as one text
END_OF_WORD = "</w>"  # suffix of tokens that end a word


class Numbers(dict):
    """Words by number; a new word gets the next number and is noted in ``fresh``."""

    def __init__(self):
        super().__init__({"": 0})
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class WordIds:
    """Token ids of whole texts, remembered by word.

    The tokenizer never joins letters over a blank, so the ids of a text are those of its words, one after the other.
    Only ASCII blanks part words here; any other white space stays inside a word and is left to the library. It lowers
    letters and parts them from the marks behind them, so that ``Word,`` is looked up as ``word`` and ``,``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        known = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(known.values(), default=0) + 1, dtype=bool)  # ids that end a word
        self.last[[n for token, n in known.items() if token.endswith(END_OF_WORD)]] = True
        self.forget()

    def forget(self) -> None:
        self.cores: dict[str, int] = {"": 0}
        self.at = Numbers()
        self.two = [np.zeros((1, 2), dtype=np.int32)]  # by word: its core and its marks
        self.flat = [np.zeros(0, dtype=np.uint32)]  # ids of the cores
        self.sizes = [np.zeros(1, dtype=np.int64)]
        self.held = 0
        self.table: tuple | None = None

    def make_room(self) -> None:
        if self.held > SEEN:
            self.forget()

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), dtype=np.int32, count=len(words))

    def learn(self) -> None:
        """Find the ids of the words that were met for the first time."""
        new, self.at.fresh = self.at.fresh, []
        if new:
            parts = [core_and_marks(w) for w in new]
            plain = list({core for core, _, letters in parts if letters}.difference(self.cores))
            self._keep(plain, *self._joined(plain))
            # after the plain ones are kept: a word may be the core of another
            other = set(chain.from_iterable((core, marks) for core, marks, _ in parts)).difference(self.cores)
            self._keep(list(other), *self._by_one(list(other)))
            number = self.cores.__getitem__
            self.two.append(np.array([(number(core), number(marks)) for core, marks, _ in parts], dtype=np.int32))
            self.held += sum(map(len, new))
        if new or self.table is None:
            self.two, self.flat, self.sizes = ([np.concatenate(x)] for x in (self.two, self.flat, self.sizes))
            self.table = self.two[0], self.flat[0], self.sizes[0], np.cumsum(self.sizes[0]) - self.sizes[0]

    def _keep(self, cores: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.cores.update(zip(cores, range(len(self.cores), len(self.cores) + len(cores)), strict=True))
        self.flat.append(flat)
        self.sizes.append(sizes)

    def _by_one(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of any cores."""
        found = [e.ids for e in self.library.encode_batch_fast(cores, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _joined(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for cores of letters, many to a text: each of them ends in an id that ends a word."""
        joined = [" ".join(cores[k : k + JOINED]) for k in range(0, len(cores), JOINED)]
        found = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *found])
        sizes = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        # a vocabulary without such ids tells no words apart
        return (flat, sizes) if len(sizes) == len(cores) and sizes.sum() == len(flat) else self._by_one(cores)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        two, flat, sizes, starts = self.table
        parts = two[numbers].ravel()
        each = sizes[parts]
        shift = starts[parts] - (np.cumsum(each) - each)
        return flat[np.repeat(shift, each) + np.arange(each.sum())]


# letters that stay as they are when texts are composed, and lower to one letter
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)").fullmatch


def core_and_marks(word: str) -> tuple[str, str, bool]:
    """Two parts that the tokenizer keeps apart: letters, lowered, and ASCII marks behind them (True). Else the word as it is."""
    found = PLAIN(word)
    return (found[1].lower(), found[2], True) if found else (word, "", False)


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lists of about ``AT_ONCE`` characters; a text is only parted at blanks."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > AT_ONCE:
            near = [p for p in (text.find(c, start + AT_ONCE) for c in " \n\t\r") if p >= 0]
            end = min(near, default=end)
        yield text[start:end].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        start = end


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode(known: WordIds, batch: list[str]) -> Iterator[np.ndarray]:
    """Ids of every text of a batch, without special tokens."""
    at = 0
    while at < len(batch):
        # numbers hold until words are forgotten: short texts are taken together, a long one part by part
        upto = next((k for k in range(at, len(batch)) if len(batch[k]) > AT_ONCE), len(batch))
        known.make_room()
        numbers = [known.numbers(next(words(t), [])) for t in batch[at:upto]]
        known.learn()
        yield from map(known.ids, numbers)
        if upto < len(batch):
            found = []
            for some in words(batch[upto]):
                known.make_room()
                few = known.numbers(some)
                known.learn()
                found.append(known.ids(few))
            yield np.concatenate(found)
        at = upto + 1


PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, part int, number bigint"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with the task that made them and their number among its pieces of that length."""

    def run(batches):
        known, part = word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(known, batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])))
                    seen[len(own)] += 1
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts(docs).mapInArrow(run, PIECES)


@dataclass
class Run:
    """``count`` pieces of one length, ``each`` to a sequence, from ``sequence`` on, at ``offset`` there."""

    length: int
    number: int
    count: int
    each: int
    sequence: int
    offset: int


class Gaps:
    """Runs of sequences by the room that is left in them."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.runs:
                insort(self.sizes, room)
                self.runs[room] = []
            self.runs[room].append((first, count))

    def least(self, size: int) -> tuple[int, int, int] | None:
        """Take a run of sequences with the least room that ``size`` fits in: (room, first, count)."""
        at = bisect_left(self.sizes, size)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        first, count = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.sizes[at]
        return room, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Where the pieces of each length go, and the number of sequences.

    Works on counts: the number of steps depends on the number of different lengths, not on the number of pieces.
    """
    left = {size: n for size, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps, sequences = Gaps(), 0

    def place(size: int, count: int, each: int, first: int, offset: int) -> None:
        runs.append(Run(size, used[size], count, each, first, offset))
        used[size] += count
        left[size] -= count

    # large pieces: at most two to a sequence, the longest with the longest that fits
    large = sorted(size for size in left if 3 * size > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect_left(large, capacity - size + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:  # nothing fits beside it
            count = left[size]
            place(size, count, 1, sequences, 0)
            gaps.add(capacity - size, sequences, count)
        elif large[at] == size and left[size] > 1:
            count = left[size] // 2
            place(size, 2 * count, 2, sequences, 0)
            gaps.add(capacity - 2 * size, sequences, count)
        elif large[at] == size:  # the last one of its length; look below it
            at -= 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
            count, other = 1, large[at] if at >= 0 else None
            place(size, 1, 1, sequences, 0)
            if other is not None:
                place(other, 1, 1, sequences, size)
            gaps.add(capacity - size - (other or 0), sequences, 1)
        else:
            other = large[at]
            count = min(left[size], left[other])
            place(size, count, 1, sequences, 0)
            place(other, count, 1, sequences, size)
            gaps.add(capacity - size - other, sequences, count)
        sequences += count

    # small pieces: where the least room is left
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.least(size)
            if found:
                room, first, count = found
            else:
                room, first = capacity, sequences
                count = -(-left[size] // (capacity // size))
                sequences += count
            each = room // size
            whole = min(count, left[size] // each)
            if whole:
                place(size, whole * each, each, first, capacity - room)
                gaps.add(room - each * size, first, whole)
            if whole < count:
                some = left[size]  # fewer than fill one more sequence
                if some:
                    place(size, some, some, first + whole, capacity - room)
                    gaps.add(room - some * size, first + whole, 1)
                    whole += 1
                gaps.add(room, first + whole, count - whole)
    return runs, sequences


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Starts jobs.

    NULL texts count as empty: one end id. Rows without doc_id and repeated rows are packed like any other. An empty
    table gives an empty result; other columns are ignored. Sequences hold at most ``capacity`` ids without gaps.
    """
    pieces = stored(token_pieces(docs, path, capacity, end_id), "packing-pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.df.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    runs.sort(key=lambda r: (r.length, r.number))
    # pieces of a length before those of this task: one row per task in each group
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.df.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.small:
        bases = F.broadcast(bases)  # as many rows as were measured
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("number"))

    key = np.array([(r.length << 48) + r.number for r in runs], dtype=np.int64)
    fixed = np.array([(r.number, r.each, r.sequence, r.offset) for r in runs], dtype=np.int64).reshape(-1, 4)

    def look_up(batches):
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            number = batch.column(5).to_numpy()
            at = fixed[np.searchsorted(key, (length << 48) + number, side="right") - 1] if len(number) else np.zeros((0, 4), dtype=np.int64)
            step = number - at[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(at[:, 2] + step // at[:, 1]), pa.array(at[:, 3] + step % at[:, 1] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        look_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )

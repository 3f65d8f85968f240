"""Phrase collocation mining by best-first branch and bound.

A search tree for each language: a node is a frequent phrase, its children are the frequent phrases with one more word
behind it. A phrase scores 1000 * a * n / (l * r) at its weakest cut (a, l, r: counts of the phrase and the two parts, n:
words of the language). No phrase is more frequent than its parts (a <= r), so that nothing under a node scores
above 1000 * n / (count of its first word): an admissible bound that a prefix count gives. Rounds grow the best part of
every language's frontier, until no bound left reaches the language's 2000th score among survivors.

A round counts the children of the nodes that grow (with a node, its suffixes grow, so that all parts of a child get
counted). A first pass counts children by hash, as numbers only: where all phrases of a hash together are too few, none is
frequent. A second pass counts the others exactly. When single words have grown, the texts are reduced in between to the
stretches in which frequent pairs may lie, with one word on either side; all further passes read these. They also
note, for phrases found in the round before, whether one same word always stands before or behind them: such a phrase
lies in a longer one of the same count and is dropped. Which phrases grow is told to the tasks by bitmaps of a fixed size; what
a bitmap lets through wrongly is removed by exact counts and joins, so that results don't depend on it. Exact counts name
phrases pair by pair and send words, no digests.

At scale: a task's counts are folded in slices of ``AT_ONCE`` words, then by Spark before and after one shuffle; a word, line
or language with a third of all words is one row per slice. Counts, frontiers and scores are tables; only the bitmaps
(``BITS`` bits each) and one row per language pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.llm.common import slices, small_batches, stored
from siltworks.sources.scratch import cut

LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 1 << 27  # bits of a bitmap: 16 MB
BUCKET = 1 << 15  # bits that Spark's bitmap functions put into one value
WIDTH = 1 << 16  # nodes of a language that the first round grows; doubles each round
AT_ONCE = 1_000_000  # words that are counted together
LONG_WORD = 64  # bytes; longer words are hashed one by one
WINDOW = 1 << 20  # bytes of texts that are split at a time
OUT_ROWS = 200_000
STRETCH = 20_000  # words of a row of reduced text
SHARES = 64

# fixed values of the text rules: ends of pieces become STOP, letters A-Z lower case, a tab a blank
STOP = b"\xff"
_RULES = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _RULES[_c] = STOP[0]
for _c in range(65, 91):
    _RULES[_c] = _c + 32
_RULES[9] = 32
RULES = bytes(_RULES)


def cut_text(text: bytes) -> Iterator[bytes]:
    """A text under the rules, in parts of about ``WINDOW`` bytes. Parted at blanks only."""
    raw = text.translate(RULES)
    start = 0
    while start < len(raw):
        end = len(raw)
        if end - start > WINDOW:
            end = raw.find(b" ", start + WINDOW)
            end = len(raw) if end < 0 else end
        yield raw[start:end]
        start = end


def split_words(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the words of a text under the rules, for each word and each end of a piece where it starts, which of these are words)."""
    data = np.frombuffer(raw, dtype=np.uint8)
    stops = data == STOP[0]
    inside = ~(stops | (data == 32))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = np.flatnonzero(begins | stops)
    words = begins[at]
    left = data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[at[words]] - np.int32(1), np.int32(len(left)))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(left)]), at, words


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its prefix and that of its last word (wraps at 64 bits)."""
    with np.errstate(over="ignore"):
        x = before + np.uint64(0x9E3779B97F4A7C15)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= word
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of words (binary), eight bytes of all words at a time; long words one by one."""
    size = len(words)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + size + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]], np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))  # the eight bytes from each byte on
    lengths = np.diff(ends)
    out = lengths.astype(np.uint64)
    long = np.flatnonzero(lengths > LONG_WORD)
    rows = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
    done = 0
    while len(rows):
        left = np.minimum(lengths[rows] - done, 8)
        some = eights[ends[rows] + done] & (np.uint64((1 << 64) - 1) >> (64 - 8 * left).astype(np.uint64))
        out[rows] = _mixed(out[rows], some)
        done += 8
        rows = rows[lengths[rows] > done]
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(words[k].as_py(), 11)
    return out


def phrase_bits(langs: list[str], phrases: list[str], bits: int) -> np.ndarray:
    """The bit of a bitmap that stands for each phrase."""
    words = [p.encode().split(b" ") for p in phrases]
    starts = np.cumsum([0, *map(len, words)])
    each = {lang: _lang_hash(lang) for lang in set(langs)}
    owner = np.repeat(np.array([each[lang] for lang in langs], dtype=np.uint64), np.diff(starts))
    hashes = _mixed(owner, word_hashes(pa.array([w for some in words for w in some], pa.binary())))
    code, sizes = hashes[starts[:-1]], np.diff(starts)
    for k in range(1, max(sizes, default=0)):
        rows = np.flatnonzero(sizes > k)
        code[rows] = _mixed(code[rows], hashes[starts[rows] + k])
    return _bit_numbers(code, bits).astype(np.int64)


def bitmap_of(bits_set: DataFrame, bits: int) -> np.ndarray:
    """A table's bit numbers (column bit) as a bitmap, packed little bits first; ``bits`` / 8 bytes at any size."""
    # bucket numbers of the bitmap functions start at 1 for bits from 1 on
    at = F.col("bit") + 1
    made = bits_set.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    return _packed(made.withColumn("bucket", F.col("bucket") - 1), bits)


def _packed(buckets: DataFrame, bits: int) -> np.ndarray:
    """One bitmap of the bitmaps (map) of buckets numbered from 0."""
    out = np.zeros(max(bits, BUCKET) // 8, dtype=np.uint8)
    for row in buckets.select("bucket", "map").collect():  # bits / BUCKET rows at most
        start = row.bucket * (BUCKET // 8)
        out[start : start + BUCKET // 8] = np.frombuffer(row.map, dtype=np.uint8)
    return out


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of a table's phrases (lang, phrase)."""

    def run(batches):
        for batch in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(phrase_bits(*(c.to_pylist() for c in batch.columns), bits))], ["bit"])

    return bitmap_of(phrases.select("lang", "phrase").mapInArrow(run, "bit bigint"), bits)


def _bit_numbers(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64(bits - 1)).astype(np.int32 if bits <= 1 << 31 else np.int64)


def _holds(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _bit_numbers(hashes, bits)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _numbered(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different ones of these numbers below ``most``, which of them each is)."""
    used = np.zeros(most, dtype=bool)
    used[numbers] = True
    return np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - np.int32(1))[numbers]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the keys, where each group starts in it)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)


class Slice:
    """The words of some documents as numbers; word 0 ends a piece. Numbers hold until ``clear``."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # languages
        self.raw: list[bytes] = []  # parts of texts that are not split yet
        self.raw_langs: list[int] = []
        self.waiting = self.bytes = self.words = 0
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # (words, which places hold one, language of each place)
        self._read = False

    def add(self, lang: str, text: bytes) -> None:
        number = self.known.setdefault(lang, len(self.known))
        for raw in cut_text(text):
            self._wait(raw, number)
        self._wait(STOP, number)

    def _wait(self, raw: bytes, lang: int) -> None:
        self.raw.append(raw)
        self.raw_langs.append(lang)
        self.waiting += len(raw)
        if self.waiting >= WINDOW:
            self._split()

    def _split(self) -> None:
        if not self.raw:
            return
        words, at, is_word = split_words(b"".join(self.raw))
        ends = np.searchsorted(at, np.cumsum([len(r) for r in self.raw]))
        owner = np.repeat(np.array(self.raw_langs, dtype=np.int32), np.diff(ends, prepend=0))
        self.parts.append((words, is_word, owner))
        self.words += len(at)
        self.bytes += self.waiting
        self.raw, self.raw_langs, self.waiting = [], [], 0

    def full(self) -> bool:
        return self.words >= AT_ONCE or self.bytes >= AT_ONCE * LONG_WORD

    def _number(self) -> None:
        """Give every word of every language that occurs a number from 1 on."""
        if self._read:
            return
        self._split()
        self._read, none = True, np.zeros(1, dtype=np.int32)
        coded = pa.concat_arrays([pa.array([], pa.binary()), *(p[0] for p in self.parts)]).dictionary_encode()
        words = coded.dictionary
        self.owner = np.concatenate([none, *(p[2] for p in self.parts), np.zeros(LONGEST, dtype=np.int32)])
        there = np.concatenate([none, *(p[1] for p in self.parts), np.zeros(LONGEST, dtype=np.int32)]).astype(bool)
        # a word of two languages is two words
        pair = coded.indices.to_numpy() + self.owner[there].astype(np.int64) * len(words)
        if len(words) * len(self.known) <= 4 * AT_ONCE:
            pairs, number = _numbered(pair, len(words) * len(self.known))
        else:
            pairs, number = np.unique(pair, return_inverse=True)
        self.token = np.zeros(len(there), dtype=np.int32)
        self.token[there] = number + 1
        self.name_langs = np.r_[0, pairs // max(1, len(words))].astype(np.int32)
        self.names = pa.concat_arrays([pa.array([b""], pa.binary()), words.take(pa.array(pairs % max(1, len(words))))])
        self._hashes = None
        self.parts = []

    def tokens(self) -> np.ndarray:
        self._number()
        return self.token

    def hashes(self) -> np.ndarray:
        self._number()
        if self._hashes is None:
            langs = np.array([_lang_hash(lang) for lang in self.known] or [0], dtype=np.uint64)
            self._hashes = _mixed(langs[self.name_langs], word_hashes(self.names))
            self._hashes[0] = 0
        return self._hashes

    def text(self, numbers: np.ndarray, stop: bytes = b"") -> pa.Array:
        """The words of these numbers; ``stop`` for 0."""
        picks, back = _numbered(numbers, len(self.names))
        words = self.names.take(pa.array(picks))
        if stop and len(picks) and picks[0] == 0:
            words = pa.concat_arrays([pa.array([stop], pa.binary()), words[1:]])
        return words.cast(pa.string()).take(pa.array(back))

    def langs(self, numbers: np.ndarray) -> pa.Array:
        """The languages of the words of these numbers."""
        return pa.array(list(self.known), pa.string()).take(pa.array(self.name_langs[numbers]))


COUNTS = "lang string, n_words int, phrase string, side int, word string, n bigint"


def _batches(lang, n_words, phrase, n, side=0, word=None) -> Iterator[pa.RecordBatch]:
    same = lambda v: pa.array(np.full(len(n), v, dtype=np.int32))
    columns = [lang, same(n_words), phrase, same(side), pa.nulls(len(n), pa.string()) if word is None else word, pa.array(n)]
    for start in range(0, len(n), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(start, OUT_ROWS) for c in columns], [c.split()[0] for c in COUNTS.split(", ")])


def count_words(held: Slice) -> Iterator[pa.RecordBatch]:
    """Counts of single words, and under n_words 0 those of all words of a language."""
    token = held.tokens()
    counts = np.bincount(token, minlength=len(held.names))
    counts[0] = 0
    there = np.flatnonzero(counts)
    yield from _batches(held.langs(there), 1, held.text(there), counts[there])
    langs = list(held.known)
    sums = np.zeros(len(langs), dtype=np.int64)
    np.add.at(sums, held.name_langs[there], counts[there])
    yield from _batches(pa.array(langs, pa.string()), 0, pa.array([""] * len(langs), pa.string()), sums)


def _levels(held: Slice, frequent: np.ndarray, growing: np.ndarray, bits: int):
    """For phrases of one word, two words and so on: (token, size, where frequent ones start, their names and hashes, which
    of them have a child that is to be counted, their next words, hashes with these)."""
    token, hashes = held.tokens(), held.hashes()
    alive_word, growing_word = _holds(frequent, hashes, bits), _holds(growing, hashes, bits)
    alive_word[0] = False
    at = np.flatnonzero(alive_word[token]).astype(np.int32)
    name, code = token[at], hashes[token[at]]
    grew = np.zeros(len(token), dtype=bool)  # does a growing phrase of one word less start here?
    for size in range(1, LONGEST):
        grows = growing_word[name] if size == 1 else _holds(growing, code, bits)
        here, live = np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=bool)
        here[at[grows]] = live[at] = True
        last = token[at + size]
        # the last words of a child must be frequent, unless they are only counted now
        child = grows & alive_word[last] & (live[at + 1] | grew[at + 1])
        longer = _mixed(code, hashes[last])
        yield token, size, at, name, code, child, last, longer
        grew = here
        stay = alive_word[last] & _holds(frequent, longer, bits)
        pair = name[stay].astype(np.int64) * len(held.names) + last[stay]
        at, code = at[stay], longer[stay]
        del longer, child
        order, starts = _groups(pair)
        name = np.empty(len(pair), dtype=np.int32)
        name[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(order)]))


HASHES = "bucket int, at binary, n binary"


def count_hashes(held: Slice, frequent: np.ndarray, growing: np.ndarray, bits: int, least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Numbers of children by hash: a row for each bucket of bits, with places in it and counts. ``least`` stands for larger ones."""
    for _, _, _, _, _, child, _, longer in _levels(held, frequent, growing, bits):
        found, n = np.unique(_bit_numbers(longer[child], bits), return_counts=True)
        if not len(found):
            continue
        buckets, at = found // BUCKET, (found % BUCKET).astype(np.uint16)
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        n = np.minimum(n, least).astype(np.min_scalar_type(least))
        columns = [pa.array(buckets[starts], pa.int32())]
        for values in (at, n):
            offsets = np.append(starts, len(found)) * values.itemsize
            columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]))
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in HASHES.split(", ")])


def enough_of(hashed: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bitmap of the hashes that ``count_hashes`` found ``least`` times in all. A bucket's rows are summed one by one."""
    kind = np.min_scalar_type(least)

    def run(batches):
        bucket, sums = None, np.zeros(BUCKET, dtype=np.int64)

        def full():
            there = sums >= least
            if bucket is not None and there.any():
                packed = pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), packed], ["bucket", "map"])
            sums[:] = 0

        for batch in slices(batches, 4096):
            for to, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != bucket:
                    yield from full()
                    bucket = to
                sums[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(n, dtype=kind)  # no place twice in a row
        yield from full()

    met = hashed.repartition("bucket").sortWithinPartitions("bucket")
    return _packed(met.mapInArrow(run, "bucket int, map binary"), bits)


def reduced_texts(held: Slice, frequent: np.ndarray, growing: np.ndarray, enough: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The stretches in which pairs may be frequent, with one word on either side: lang, text."""
    token, _, at, _, _, child, last, longer = next(_levels(held, frequent, growing, bits))
    pair = at[(child & _holds(enough, longer, bits)) | ((last > 0) & _holds(frequent, longer, bits))]
    keep = np.zeros(len(token) + 1, dtype=bool)
    for shift in (-1, 0, 1, 2):
        keep[pair + shift] = True
    keep = keep[:-1] & (token > 0)
    del at, child, last, longer, pair
    where = np.flatnonzero(keep).astype(np.int32)
    if not len(where):
        return
    owner = held.owner[where]
    order = np.argsort(owner, kind="stable").astype(np.int32)
    where, owner = where[order], owner[order]
    fresh = np.r_[True, np.diff(where) != 1]  # a stop before each stretch
    place = np.arange(len(where), dtype=np.int32) + np.cumsum(fresh, dtype=np.int32)
    words = np.zeros(place[-1] + 1, dtype=np.int32)
    words[place] = token[where]
    begins = place[fresh] - 1
    # rows of some length, cut at stops and between languages
    block = np.cumsum(np.r_[True, (np.diff(begins // STRETCH) > 0) | (np.diff(owner[fresh]) > 0)])
    offsets = np.r_[begins[np.r_[True, np.diff(block) > 0]], len(words)]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held.text(words, b"\n")), " ")
    yield pa.RecordBatch.from_arrays([held.langs(words[offsets[:-1] + 1]), text], ["lang", "text"])


def count_grown(
    held: Slice, frequent: np.ndarray, growing: np.ndarray, enough: np.ndarray, fresh: np.ndarray, bits: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the children of growing phrases. And for the phrases found last, as n_words of less than 0, the word that
    always stands before (side 0) and behind them (1) in this slice; '' is the end of a piece, NULL several words."""

    def phrases(token, where, size):
        picks = [token[where + k] for k in range(size)]
        parts = [held.text(p) for p in picks]
        return held.langs(picks[0]), pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]

    for token, size, at, name, code, child, last, longer in _levels(held, frequent, growing, bits):
        if size > 1:
            new = _holds(fresh, code, bits)
            order, starts = _groups(name[new])
            if len(starts):
                where = at[new][order]
                langs, texts = phrases(token, where[starts], size)
                n = np.diff(np.r_[starts, len(where)])
                for side, next_to in enumerate((token[where - 1], token[where + size])):
                    least, most = np.minimum.reduceat(next_to, starts), np.maximum.reduceat(next_to, starts)
                    word = pc.if_else(pa.array(least == most), held.text(least), pa.scalar(None, pa.string()))
                    yield from _batches(langs, -size, texts, n, side, word)
        child &= _holds(enough, longer, bits)
        order, starts = _groups(name[child].astype(np.int64) * len(held.names) + last[child])
        if len(starts):
            where = at[child][order][starts]
            langs, texts = phrases(token, where, size + 1)
            yield from _batches(langs, size + 1, texts, np.diff(np.r_[starts, len(order)]))


def _passed(docs: DataFrame, each, schema: str) -> DataFrame:
    """One pass over the texts: what ``each`` makes of every slice."""

    def run(batches):
        held = Slice()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(lang, text)
                if held.full():
                    yield from each(held)
                    held = Slice()
        if held.known:
            yield from each(held)

    return docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, schema)


def _counted(docs: DataFrame, count) -> DataFrame:
    """Partial counts of every slice, summed."""
    return _passed(docs, count, COUNTS).groupBy("lang", "n_words", "phrase", "side", "word").agg(F.sum("n").alias("f"))


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, n_words, f, n) with a, l, r, n and score of their weakest cut; ties go to the first cut.

    Products are decimals of 38 digits: exact for languages of up to 10^17 words.
    """
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "n_words", "n", F.col("f").alias("a"), words.alias("_w")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "n_words", "a", "n", "k",
        F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice("_w", F.col("k") + 1, F.col("n_words")), " ").alias("_right"),
    )
    left = known.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    met = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    met = met.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * whole("a", 17) * whole("n", 17)).withColumn("_down", whole("l", 19) * whole("r", 19))
    met = met.withColumn("score", F.expr("_up div _down"))
    least = met.groupBy("lang", "phrase", "n_words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_least"))
    return least.select("lang", "phrase", "n_words", "a", "_least.l", "_least.r", "n", "_least.score")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank; shares of a language are cut first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    some = found.withColumn("_k", F.row_number().over(share)).filter(F.col("_k") <= top).drop("_k")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)


def _suffixes(nodes: DataFrame) -> DataFrame:
    """Each phrase with all its suffixes."""
    words = F.split("phrase", " ")
    starts = F.explode(F.sequence(F.lit(1), F.size(words)))
    at = nodes.select("lang", words.alias("_w"), starts.alias("_s"))
    return at.select("lang", F.array_join(F.slice("_w", F.col("_s"), F.size("_w")), " ").alias("phrase")).distinct()


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, bits: int = BITS
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score. Starts jobs.

    Phrases have 2 to 5 words and occur at least ``least`` times. A NULL language is ``und``, a NULL text empty;
    repeated rows count each time, doc_id and other columns are ignored. Ties in the score go to the more frequent, then to
    the smaller phrase (by bytes). A language without such phrases has no rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = _counted(source, count_words).filter((F.col("n_words") == 0) | (F.col("f") >= least))
    counted = stored(counted.select("lang", "phrase", "n_words", "f"), "phrases-words")
    summed = cut(counted.filter("n_words = 0").select("lang", F.col("f").alias("n")), "phrases-totals")
    totals = summed.df

    def with_lang(rows: DataFrame, per_lang: DataFrame) -> DataFrame:
        """A join with one row per language, which are broadcast if they were measured to be few."""
        return rows.join(F.broadcast(per_lang) if summed.small else per_lang, "lang")

    known = counted.filter("n_words = 1").select("lang", "phrase", "n_words", "f")
    # what a node can lead to scores at most 1000 n / (count of its first word)
    nodes = stored(with_lang(known, totals).withColumn("bound", F.expr("1000 * cast(n as decimal(20,0)) div f")).drop("n"), "phrases-nodes")
    grown: DataFrame | None = None
    fresh: DataFrame | None = None
    dropped = spark.createDataFrame([], "lang string, phrase string, lone boolean")
    scores: DataFrame | None = None
    reduced: DataFrame | None = None  # the texts without what can't be in a phrase
    while True:
        # (language, score to reach): only survivors that are known to survive count
        needed = totals.select("lang", F.lit(-1).cast("bigint").alias("needed"))
        pending = None
        if scores is not None:
            sure = scores.join(dropped, ["lang", "phrase"], "left").filter((F.col("n_words") == LONGEST) | F.col("lone").isNotNull())
            last = _best(sure.filter((F.col("n_words") == LONGEST) | ~F.col("lone")), top).filter(F.col("rank") == top)
            needed = stored(needed.drop("needed").join(last.select("lang", F.col("score").alias("needed")), "lang", "left").fillna(-1), "phrases-needed")
            unsure = scores.filter(F.col("n_words") < LONGEST).join(dropped, ["lang", "phrase"], "left_anti")
            pending = stored(with_lang(unsure, needed).filter("score >= needed").select("lang", "phrase"), "phrases-pending")
        ready = nodes.filter(F.col("n_words") < LONGEST)
        if grown is not None:
            ready = ready.join(grown, ["lang", "phrase"], "left_anti")
        ready = stored(with_lang(ready, needed).filter("bound >= needed"), "phrases-ready")
        # the best of each language's frontier; all of it when it is small
        size, at = F.count(F.lit(1)), F.percentile_approx("bound", [1 - k / SHARES for k in range(1, SHARES + 1)], 10_000)
        limit = F.when(size <= width, F.min("bound")).otherwise(F.get(at, F.floor(F.lit(width * SHARES) / size).cast("int")))
        chosen = with_lang(ready, ready.groupBy("lang").agg(limit.alias("_limit"))).filter("bound >= _limit").select("lang", "phrase")
        growing = _suffixes(chosen)
        if grown is not None:
            growing = growing.join(grown, ["lang", "phrase"], "left_anti")
        growing = stored(growing, "phrases-growing")
        nothing = growing.isEmpty()
        if nothing and (pending is None or pending.isEmpty()):
            break
        width *= 2
        empty = np.zeros(max(bits, BUCKET) // 8, dtype=np.uint8)
        maps = [spark.sparkContext.broadcast(m) for m in (bitmap(nodes, bits), bitmap(growing, bits))]
        words_grow = not growing.filter(~F.contains("phrase", F.lit(" "))).isEmpty()
        hashed = _passed(source if words_grow else reduced, lambda held, maps=tuple(maps): count_hashes(held, *(m.value for m in maps), bits, least), HASHES)
        maps.append(spark.sparkContext.broadcast(enough_of(hashed, least, bits)))
        if words_grow:
            shorter = _passed(source, lambda held, maps=tuple(maps): reduced_texts(held, *(m.value for m in maps), bits), "lang string, text string")
            reduced = stored(shorter, "phrases-texts")
        maps.append(spark.sparkContext.broadcast(bitmap(fresh, bits) if fresh is not None else empty))
        made = _counted(reduced, lambda held, maps=tuple(maps): count_grown(held, *(m.value for m in maps), bits))
        made = stored(made.filter((F.col("n_words") < 0) | (F.col("f") >= least)), "phrases-counted")
        for m in maps:
            m.destroy()
        if fresh is not None:
            sides = made.filter("n_words < 0").groupBy("lang", "phrase", "side").agg(F.count(F.lit(1)).alias("_n"), F.max("word").alias("_word"))
            always = (F.col("_n") == 1) & (F.coalesce("_word", F.lit("")) != "")
            told = sides.groupBy("lang", "phrase").agg(F.max(always).alias("lone")).join(fresh.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
            dropped = stored(dropped.unionByName(told), "phrases-dropped")
        # children of phrases that really grow
        new = made.filter("n_words > 1").withColumn("_parent", F.regexp_extract("phrase", r"(?s)^(.*) [^ ]*\z", 1))
        new = new.join(growing.select("lang", F.col("phrase").alias("_parent")), ["lang", "_parent"], "left_semi")
        first = known.filter("n_words = 1").select("lang", F.col("phrase").alias("_first"), F.col("f").alias("_f"))
        new = new.withColumn("_first", F.substring_index("phrase", " ", 1)).join(first, ["lang", "_first"])
        new = with_lang(new, totals).withColumn("bound", F.expr("1000 * cast(n as decimal(20,0)) div _f"))
        fresh = stored(new.select("lang", "phrase", "n_words", "f", "bound"), "phrases-new")
        grown = growing if grown is None else stored(grown.unionByName(growing), "phrases-grown")
        nodes = stored(nodes.unionByName(fresh), "phrases-nodes")
        more = scored(with_lang(fresh.drop("bound"), totals), nodes)
        scores = stored(more if scores is None else scores.unionByName(more), "phrases-scores")
    if scores is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    gone = dropped.filter("lone").select("lang", "phrase")
    left = scores.join(gone, ["lang", "phrase"], "left_anti")
    return _best(left, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a generalised pigeonhole search.

1. Fingerprints: a narrow map, one pass over the text.
2. Distinct fingerprints only are searched. Their bits are grouped into partitions so that correlated bits lie together.
3. With m partitions and thresholds t_1..t_m (each at least -1) that sum to distance - m + 1, two fingerprints within
   ``distance`` bits differ by at most t_i bits in some partition i. A dynamic program gives each partition its own
   threshold, by the number of candidates that its value counts lead one to expect; m itself is chosen by the same sum.
4. Probe and verify: every fingerprint lives at its own value of each partition and visits the values within t_i
   bits (one of two partners visits the other, so a link is met once per partition). The equi-join on
   (partition, value) verifies the distance in its condition, so candidates are compared but never written.
5. Components over the links give the smallest reachable doc_id.

The near-duplicate stage also links texts by exact shingle similarity. A text sends the first fifth of its shingles in one
global order (rare ones first, common ones by how many documents have them); whatever is similar enough meets there, and
candidates are verified by their whole sets.

At scale: texts are never shuffled; a row of the search is three integers. Copies are one fingerprint, however many.
The residents of a value with more than ``LANE`` of them are dealt over lanes and its visitors copied once per lane, so
no task holds an unbounded group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import bounded_sample, slices, stored, texts
from siltworks.llm.components import components
from siltworks.sources.scratch import cut

BITS = 64
WORDS = 4
DISTANCE = 4
SEED = 42
SHINGLE, SIMILARITY = 5, 0.8  # links by the texts' word shingles, at any distance of the fingerprints
# The order of shingles follows one document in ``ORDERED_PART``, at least ``ORDERED``, so the number of documents beyond which a
# shingle is known as common does not grow with the input. Those that ``COMMON`` of them have come last; at most so many.
ORDERED, ORDERED_PART, COMMON, MOST_COMMON = 1024, 16, 4, 500_000
LANE = 2048
MET_BYTES = 4 * 1024 * 1024  # shingles that several texts have, up to which they are broadcast: as a relation they take the driver some three times that
SAMPLE = 4096  # fingerprints from which bit correlations and candidate counts are estimated
MOST_PARTITIONS = 8
ROW_COST = 30  # cost of a row that is sent, in compared pairs
AT_ONCE = 1 << 18  # shingles hashed at a time


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the hashes of all word shingles; 0 without a word."""
    found = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(found) - words + 1
    total = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        upto = min(n, at + AT_ONCE)
        spans = zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(BITS) if 2 * total[k] > n))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Plan:
    """Bit masks of the partitions (unsigned) and the threshold of each; -1: not probed."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size; each group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    near = np.abs(centred.T @ centred) / max(1, len(bits))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group: list[int] = []
        while len(group) < size:
            pick = max(left, key=lambda b: (near[b, group].sum() if group else -near[b, list(left)].sum(), -b))
            group.append(pick)
            left.remove(pick)
        groups.append(sorted(group))
    return groups


def _ball(bits: int, radius: int) -> float:
    """Values visited within ``radius`` bits: one of two partners visits the other."""
    return 1 + sum(comb(bits, r) for r in range(1, radius + 1)) / 2


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least summed cost that sum to ``total``; ``costs[i][t + 1]`` is the cost of threshold t in part i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if (key := spent + k - 1) not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, (*chosen, k - 1))
        best = step
    return best.get(total, (inf, ()))


def make_plan(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> Plan:
    """Partitions and thresholds for ``rows`` distinct fingerprints, of which ``sample`` is a random part.

    Any plan finds every link; the sample only decides what the search costs.
    """
    choice: tuple[float, Plan] | None = None
    rows = max(rows, 2)  # also for an empty table a plan of few probes
    half = len(sample) // 2
    a, b = sample[:half], sample[half : 2 * half]
    for parts in range(1, min(MOST_PARTITIONS, distance + 1) + 1):
        total = distance - parts + 1
        groups = bit_groups(sample, parts)
        masks = tuple(sum(1 << k for k in g) for g in groups)
        costs = []
        for mask, group in zip(masks, groups, strict=True):
            apart = np.zeros(len(group) + 1)
            for turn in range(min(256, half)):  # many pairings of the two halves
                apart += np.bincount(np.bitwise_count((a ^ np.roll(b, turn)) & np.uint64(mask)), minlength=len(apart))
            chance = np.array([comb(len(group), r) for r in range(len(group) + 1)]) / 2.0 ** len(group)
            share = np.cumsum(apart + chance) / (apart.sum() + 1)
            row = [0.0]
            for t in range(min(total + parts - 1, len(group)) + 1):
                row.append(rows * _ball(len(group), t) * ROW_COST + rows * rows / 2 * share[t])
            costs.append(row)
        cost, thresholds = allocate(costs, total)
        if choice is None or cost < choice[0]:
            choice = (cost, Plan(masks, thresholds))
    return choice[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flips(mask: int, radius: int) -> list[tuple[int, int]]:
    """(bits to flip, the lowest of them) for every way to move at most ``radius`` bits of a partition."""
    bits = [1 << k for k in range(BITS) if mask >> k & 1]
    return [(sum(some), some[0]) for r in range(1, radius + 1) for some in combinations(bits, r)]


def links(distinct: DataFrame, plan: Plan, distance: int = DISTANCE) -> DataFrame:
    """All pairs (a, b, bits) of the distinct fingerprints ``fp`` within ``distance`` bits, each once. Starts jobs."""
    lives, visits = None, None
    for part, (mask, radius) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
        if radius < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        home = distinct.select(F.lit(part).alias("part"), value.alias("value"), "fp")
        lives = home if lives is None else lives.union(home)
        moves = home.select("part", "value", "fp", F.lit(True).alias("at_home"))
        if radius:
            flips = F.array(*(F.struct(F.lit(_signed(f)).alias("f"), F.lit(_signed(low)).alias("low")) for f, low in _flips(mask, radius)))
            away = home.select("part", "value", "fp", F.explode(flips).alias("x"))
            # of two partners the one whose lowest differing bit is 0 visits the other
            away = away.filter(F.col("value").bitwiseAND(F.col("x.low")) == 0)
            moves = moves.union(away.select("part", F.col("value").bitwiseXOR(F.col("x.f")), "fp", F.lit(False)))
        visits = moves if visits is None else visits.union(moves)
    full = stored(
        lives.groupBy("part", "value").count().filter(F.col("count") > LANE)
        .select("part", "value", F.ceil(F.col("count") / LANE).cast("int").alias("lanes")), "full-values",
    )
    if not full.isEmpty():
        lives = lives.join(full, ["part", "value"], "left")
        visits = visits.join(full, ["part", "value"], "left")
    else:
        lives, visits = lives.withColumn("lanes", F.lit(1)), visits.withColumn("lanes", F.lit(1))
    lanes = F.coalesce("lanes", F.lit(1))
    lives = lives.select("part", "value", F.col("fp").alias("a"), F.pmod(F.xxhash64("fp"), lanes).cast("int").alias("lane"))
    visits = visits.select("part", "value", F.col("fp").alias("b"), "at_home", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    on = [lives[c] == visits[c] for c in ("part", "value", "lane")]
    met = lives.join(visits, on + [bits <= distance, ~F.col("at_home") | (F.col("a") < F.col("b"))])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bits.alias("bits")).distinct()


def search(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """:func:`links` by a plan made for the stored table ``distinct`` (fp). Starts jobs."""
    sample = bounded_sample(distinct, "fp", SAMPLE).limit(2 * SAMPLE).toArrow().column("fp").to_numpy().astype(np.int64)
    sample = np.sort(sample).view(np.uint64)
    np.random.default_rng(0).shuffle(sample)
    return links(distinct, make_plan(sample, distinct.count(), distance), distance)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id. Starts jobs.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable, the own
    one included. Texts without a word (NULL, empty, white space) have fingerprint zero and are linked like any other;
    texts of fewer than ``words`` words are one shingle. Rows without doc_id link too, but give no id: a component of only
    such rows has a NULL id. Repeated rows are each returned. Other columns are ignored.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-set")
    roots = components(search(distinct.select("fp"), distance).select("a", "b"))
    roots = stored(roots, "fingerprint-roots")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = named.join(ids, "root").select("fp", "component_id")
    return marked.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes (signed) of the distinct shingles of ``words`` words of a text; of all words, if there are fewer."""
    found = text.lower().encode().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64).view(np.int64)
    parts = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), dtype=np.uint64, count=len(found))
    n = len(found) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        out = (out ^ parts[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _text_key(text: str) -> int:
    """64 bits that stand for a text as :func:`fingerprint` sees it; equal keys have equal fingerprints."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED + 1))


def _sets(docs: DataFrame) -> DataFrame:
    """key and s, the shingles, of every text."""

    def run(batches):
        for batch in slices(batches):
            some = batch.column(1).to_pylist()
            sets = pa.array([shingle_set(t) for t in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_text_key(t) for t in some], pa.int64()), sets], ["key", "s"])

    return texts(docs).mapInArrow(run, "key bigint, s array<bigint>")


@dataclass(frozen=True)
class Common:
    """Shingles that many documents of a sample have, sorted, and how many have each. They only decide the order of shingles,
    hence what the search costs."""

    shingles: np.ndarray
    counts: np.ndarray

    def count(self, shingles: np.ndarray) -> np.ndarray:
        """Of every shingle; 0 for one that is not common."""
        if not len(self.shingles):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.counts[at], 0)


def common_shingles(docs: DataFrame) -> Common:
    """The common shingles of ``docs``. Starts jobs."""
    kinds = _sets(bounded_sample(docs, "doc_id", ORDERED, ORDERED_PART)).dropDuplicates(["key"])  # copies are one text
    found = kinds.select(F.explode("s").alias("x"))
    often = found.groupBy("x").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "x").limit(MOST_COMMON).toArrow()
    shingles, counts = (often.column(c).to_numpy() for c in ("x", "count"))
    order = np.argsort(shingles)
    return Common(shingles[order], counts[order])


def prefix(shingles: np.ndarray, common: Common, similarity: float) -> np.ndarray:
    """The first of the sorted shingles, common ones last. With one order for all, two sets of at least ``similarity`` share one of
    these: the common part is at least ``similarity`` of the larger set, so it does not fit behind the prefix of either."""
    n = len(shingles)
    return shingles[np.argsort(common.count(shingles), kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1]


def near_units(docs: DataFrame, common: Common, similarity: float) -> DataFrame:
    """doc_id, fp, key, size (number of shingles) and first, their prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MOST_COMMON

    def run(batches):
        for batch in slices(batches):
            some = batch.column(1).to_pylist()
            prints = np.array([fingerprint(t) for t in some], dtype=np.uint64)
            sets = [shingle_set(t) for t in some]
            columns = [pa.array(prints.view(np.int64)), pa.array([_text_key(t) for t in some], pa.int64()), pa.array([len(x) for x in sets], pa.int32())]
            first = pa.array([prefix(x, shared.value, similarity) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, first], ["doc_id", "fp", "key", "size", "first"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint, key bigint, size int, first array<bigint>")


def alike(docs: DataFrame, units: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the roots of texts that share at least ``similarity`` of their word shingles, all of them but those that
    ``roots`` (node, root; by default the fingerprint itself) already joins. Exact: texts of that similarity meet at a shingle of both prefixes, and
    at so many that the rest behind a prefix can make up what they must share. Starts jobs.
    """
    kinds = units.select("key", "fp", "size", "first").dropDuplicates(["key"])
    kinds = kinds.join(roots, kinds["fp"] == roots["node"], "left").select("key", "size", "first", F.coalesce("root", "fp").alias("root"))
    rows = stored(kinds, "near-kinds").select(F.explode("first").alias("shingle"), "key", "size", "root", (F.col("size") - F.size("first")).alias("rest"))
    full = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    # where all are joined already there is nothing to find
    full = cut(full.filter("n > 1 AND low < high").select("shingle", F.ceil(F.col("n") / LANE).cast("int").alias("lanes")), "near-met")
    rows = rows.join(F.broadcast(full.df) if full.bytes <= MET_BYTES else full.df, "shingle")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("key", "size", "root", "rest")]
    x = rows.select("shingle", F.pmod(F.xxhash64("key"), F.col("lanes")).cast("int").alias("lane"), *side("x"))
    y = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), *side("y"))
    met = x.join(y, ["shingle", "lane"]).filter(
        (F.col("x_key") < F.col("y_key")) & (F.col("x_root") != F.col("y_root"))
        & (F.least("x_size", "y_size") >= similarity * F.greatest("x_size", "y_size"))
    )
    ends = met.groupBy("x_key", "y_key").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("x_root", "y_root", "x_size", "y_size", "x_rest", "y_rest")))
    needed = similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-9
    enough = ends.filter(F.col("n") + F.greatest("x_rest", "y_rest") >= needed)
    pairs = stored(enough.select("x_key", "x_root", "y_key", "y_root"), "near-candidates")
    ends = pairs.select(F.col("x_key").alias("key")).union(pairs.select("y_key")).distinct()
    wanted = cut(ends.join(units, "key").groupBy("key").agg(F.min("doc_id").alias("least")).select("least").distinct(), "near-owners")
    chosen = F.broadcast(wanted.df) if wanted.small else wanted.df
    sets = stored(_sets(texts(docs).join(chosen, F.col("doc_id") == F.col("least"))).dropDuplicates(["key"]), "near-sets")
    u = sets.select(F.col("key").alias("x_key"), F.col("s").alias("x"))
    v = sets.select(F.col("key").alias("y_key"), F.col("s").alias("y"))
    both = pairs.join(u, "x_key").join(v, "y_key").withColumn("common", F.size(F.array_intersect("x", "y")))
    near = both.filter(F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common")) - 1e-9)
    return near.select(F.col("x_root").alias("a"), F.col("y_root").alias("b"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near duplicates: the smallest doc_id.

    Documents are near duplicates if their fingerprints are within ``DISTANCE`` bits, or if the similarity of their
    five-word shingles is at least ``similarity``, however far apart the fingerprints are; groups are what is linked over
    any number of others. Rows without doc_id stay and take no part; rows that repeat a doc_id stay or go together.
    Starts jobs.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    marked = stored(near_units(named, common_shingles(named), similarity), "near-units")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-set")
    joined = stored(components(search(distinct.select("fp")).select("a", "b")), "near-roots")
    owners = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("least", F.coalesce("root", "fp").alias("part"))
    # whole components are linked, not their members once more
    further = stored(components(alike(named, marked, joined, similarity)), "further-roots")
    owners = owners.join(further, owners["part"] == further["node"], "left").select("least", F.coalesce("root", "part").alias("root"))
    stays = owners.groupBy("root").agg(F.min("least").alias("_stays"))
    gone = marked.select("doc_id").distinct().join(stays, F.col("doc_id") == F.col("_stays"), "left_anti")
    gone = cut(gone.select(F.col("doc_id").alias("_gone")), "near-gone")
    # by frame: a document column may have the same name
    return docs.join(F.broadcast(gone.df) if gone.small else gone.df, docs["doc_id"].cast("bigint") == gone.df["_gone"], "left_anti")

"""Repair of conversation structure by weighted interval parsing.

A conversation is right when its role initials are ``(s?(ua)+)?``. A repair grammar in Chomsky normal form gives every
way to get there: a nonterminal ``[q, r]`` derives a span of rows that leads from state q to state r,

    [q, r] -> [q, p] [p, r]        two neighbouring spans
    [q, r] -> row                  kept, given another role, or deleted
    [q, r] -> (nothing)            by inserted turns; the closure of these is taken into every cell

A cell of the chart holds the least (cost, audit) of its span. Spans are combined bottom-up by length. As there is a
nonterminal for every pair of states, each derivation of a span passes some state at every inner point, so that every
split of a span gives the same cells; one split is enough, and a chart of n rows has n - 1 combinations. Of two audits
of a cell with equal costs none begins with the other, so that the least of the parts give the least of the whole.

At scale: rows are ranged by (conversation, turn), so a conversation with a third of all rows lies on many tasks;
each parses the stretch that it holds, and the cells of stretches are combined afterwards (at most two open
conversations a task). First rows of repeated (role, text) are found by an aggregate and a join that deals out hot keys.
Texts move once, for the digest of the repaired conversation, which is sequential by its nature; they are streamed.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import slices, stored
from siltworks.operators.skew import skew_join
from siltworks.sources.scratch import cut

# fixed values of the rules
NAMES = {"u": "user", "a": "assistant"}
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # start, behind s, behind u, behind a
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = r"[\x20\x09-\x0D]"
GONE, BLANK, REPEATED, CUT, FINE = "gone", "blank", "duplicate", "truncated", "fine"

BLOCK = 64  # rows whose cells are remembered by their kinds
Cells = tuple  # 4 x 4 of (cost, audit) or None


def combined(x: Cells, y: Cells) -> Cells:
    """Cells of two neighbouring spans taken together."""
    out = []
    for q in range(4):
        row = []
        for r in range(4):
            found = [(x[q][p][0] + y[p][r][0], x[q][p][1] + y[p][r][1]) for p in range(4) if x[q][p] and y[p][r]]
            row.append(min(found, default=None))
        out.append(tuple(row))
    return tuple(out)


def _closure() -> Cells:
    """What insertions alone can do; two of them reach every state that can be reached."""
    none = tuple(tuple((0, "") if q == r else None for r in range(4)) for q in range(4))
    one = [list(row) for row in none]
    for (q, letter), r in STEPS.items():
        if letter in NAMES:
            one[q][r] = (INSERT, "I")
    once = tuple(map(tuple, one))
    return combined(once, once)


INSERTED = _closure()


def row_code(initial: str, fault: str) -> str:
    """One character for what the grammar sees of a row: ``x`` must go, upper case is truncated, ``o`` is another role."""
    if fault in (BLANK, REPEATED):
        return "x"
    code = initial if initial in ("s", "u", "a") else "o"
    return code.upper() if fault == CUT else code


def row_cells(code: str) -> Cells:
    out = [[None] * 4 for _ in range(4)]
    for q in range(4):
        ways = [(DELETE, "D", q)]
        if code != "x":
            more = TRUNCATED if code.isupper() else 0
            if (q, code.lower()) in STEPS:
                ways.append((more, "K", STEPS[q, code.lower()]))
            ways += [(REROLE + more, "R", STEPS[q, letter]) for letter in NAMES if (q, letter) in STEPS]
        for cost, edit, r in ways:
            out[q][r] = min(x for x in (out[q][r], (cost, edit)) if x)
    return combined(combined(INSERTED, tuple(map(tuple, out))), INSERTED)


@functools.lru_cache(maxsize=1 << 14)
def span_cells(codes: str) -> Cells:
    """Cells of a span of at most ``BLOCK`` rows: halves are combined bottom-up."""
    if len(codes) <= 1:
        return row_cells(codes) if codes else INSERTED
    half = 1 << (len(codes) - 1).bit_length() - 1
    return combined(span_cells(codes[:half]), span_cells(codes[half:]))


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0][r] for r in ENDS if cells[0][r])


@dataclass
class Stretch:
    """Neighbouring rows of a conversation: counts, and the cells of spans of doubling length."""

    spans: list[tuple[int, Cells]] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    rows: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault == GONE:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += fault == BLANK
        self.duplicate += fault == REPEATED
        self.truncated += fault == CUT
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        self.codes.append(row_code(initial, fault))
        if len(self.codes) == BLOCK:
            self._close()

    def _close(self) -> None:
        if self.codes:
            self._push(0, span_cells("".join(self.codes)))
            self.codes = []

    def _push(self, level: int, cells: Cells) -> None:
        while self.spans and self.spans[-1][0] == level:
            cells, level = combined(self.spans.pop()[1], cells), level + 1
        self.spans.append((level, cells))

    def cells(self) -> Cells:
        self._close()
        out = INSERTED
        for _, cells in reversed(self.spans):
            out = combined(cells, out)
        return out

    def behind(self, other: Stretch, cells: Cells) -> None:
        """Take in the stretch that follows, whose cells are given."""
        if not other.rows:
            return
        if other.first_turn is not None:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        self.illegal += other.illegal
        if self.rows:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        else:
            self.first = other.first
        self.last, self.rows = other.last, self.rows + other.rows
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self._close()
        self._push(0, cells)

    def report(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(self.cells())
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
OPEN = "part int, counts array<bigint>, ends array<string>, costs array<bigint>, audits array<string>"
_report = [pa.int64()] * 7 + [pa.string()]
_open = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]


def _named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _opened(at: Stretch) -> tuple:
    flat = [c for row in at.cells() for c in row]
    counts = [at.rows, at.turns, at.first_turn, at.last_turn, at.blank, at.duplicate, at.truncated, at.illegal]
    return counts, [at.first, at.last], [c and c[0] for c in flat], [c and c[1] for c in flat]


def _again(counts: list, ends: list, costs: list, audits: list) -> tuple[Stretch, Cells]:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    rows, turns, first, last, blank, duplicate, truncated, illegal = counts
    at = Stretch(rows=rows, turns=turns, first_turn=first, last_turn=last, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, first=ends[0], last=ends[1])
    return at, tuple(tuple(flat[4 * q : 4 * q + 4]) for q in range(4))


def parse_stretches(rows: DataFrame) -> DataFrame:
    """Sorted rows (conv_id, turn, initial, fault) to reports, and to open stretches at either end of a partition."""

    def run(batches):
        part = TaskContext.get().partitionId()
        now, at, leading, out = None, None, True, []

        def closed(is_open):
            return (now[0], *[None] * 7, part, *_opened(at)) if is_open else (now[0], *at.report(), *[None] * 5)

        def emit():
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _report + _open, strict=True)]
            return pa.RecordBatch.from_arrays(columns, _named(f"{REPORT}, {OPEN}"))

        for batch in slices(batches, 4096):
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        out.append(closed(leading))
                        leading = False
                    now, at = (conv,), Stretch()
                at.add(turn, initial, fault)
            if out:
                yield emit()
                out = []
        if now:
            out.append(closed(True))
            yield emit()

    return rows.mapInArrow(run, f"{REPORT}, {OPEN}")


def join_stretches(stretches: DataFrame) -> DataFrame:
    """One report for each conversation from its stretches, taken in the order of their partitions."""

    def run(batches):
        now, at = None, None

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((now[0], *at.report()), _report, strict=True)], _named(REPORT))

        for batch in batches:
            for k in range(batch.num_rows):  # stretches can be long; one at a time
                conv, _, *held = (c[k].as_py() for c in batch.columns)
                if now != (conv,):
                    if now:
                        yield emit()
                    now, at = (conv,), Stretch()
                at.behind(*_again(*held))
        if now:
            yield emit()

    columns = ["conv_id", *_named(OPEN)]
    ordered = stretches.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the test damage: one row in 20 each is dropped (``gone``), emptied, robbed of its
    sentence ends, repeated, or said by the user. NULL roles and texts (and NULLs in the hashed name) are one space."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(named) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Stored rows with their first fault; rows of one turn are taken by role and digest of the text."""
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){WHITE}*\z", 1)
    seen = stored(
        rows.select(
            "conv_id", "turn", "role", "text", "gone", F.sha2("text", 256).alias("text_key"),
            (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("rid"),
        ).withColumn("key", F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), "text_key", "role")),
        "turns",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "rid")
    said = seen.filter("not gone and not blank").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    repeats = cut(said.filter("n > 1").select("key", F.col("first.rid").alias("first")), "turns-repeats")
    met = skew_join(seen, repeats, "key", "left")
    fault = (
        F.when(F.col("gone"), GONE).when(F.col("blank"), BLANK)
        .when(F.col("first") != F.col("rid"), REPEATED).when(F.col("cut"), CUT).otherwise(FINE)
    )
    return met.select("conv_id", "turn", "role", "text", "text_key", "rid", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """Least repair of every conversation. Starts jobs.

    ``rows`` has conv_id, turn, role, text and optionally ``gone`` (rows that count for nothing, though their
    conversation is reported). Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, the digest of the repaired ``role:text`` lines.

    Rows are taken by turn (NULL first), then role, then digest of the text. A NULL role or text is one space; an
    empty role has a blank initial and can't be kept. Rows without conv_id are one conversation. A conversation
    without rows has zeros, an empty audit and the digest of nothing. Repeated rows are duplicates. An empty table
    gives an empty result; other columns are ignored.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"),
    )
    marked = _marked(rows)
    order = ["turn", "role", "text_key", "rid"]
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial")
    narrow = marked.select("conv_id", *order, initial, "fault")
    ranged = narrow.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    parsed = stored(parse_stretches(ranged.select("conv_id", "turn", "initial", "fault")), "turns-parsed")
    reports = parsed.filter("part is null").select(*_named(REPORT)).unionByName(join_stretches(parsed.filter("part is not null")))

    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in REPORT.split(", ")) if c != "conv_id"}
    said = marked.filter(F.col("fault") != GONE).select("conv_id", F.lit(1).alias("_seq"), *order, "text", *(c.alias(n) for n, c in none.items()))
    blank_row = {"turn": "bigint", "role": "string", "text_key": "string", "rid": "bigint", "text": "string"}
    heads = reports.withColumn("_seq", F.lit(0)).withColumns({n: F.lit(None).cast(t) for n, t in blank_row.items()})
    both = said.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "_seq", *order)
    return repaired_digests(both)


def repaired_digests(rows: DataFrame) -> DataFrame:
    """Apply each conversation's audit (its first row) to the rows behind it and digest what results."""

    def run(batches):
        head, out = None, []
        state = pos = 0
        sha = hashlib.sha256()
        started = False

        def line(role, text):
            nonlocal started, state
            sha.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True
            state = STEPS[state, role[0]]

        def other():
            return NAMES["a" if state == 2 else "u"]

        def inserted():
            nonlocal pos
            while pos < len(head[-1]) and head[-1][pos] == "I":
                line(other(), "")
                pos += 1

        def emit():
            kinds = [*_report, pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, [*_named(REPORT), "repaired_sha256"])

        for batch in slices(batches):
            for seq, role, text, *report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq == 0:
                    if head:
                        inserted()
                        out.append((*head, sha.hexdigest()))
                    head, state, pos, sha, started = report, 0, 0, hashlib.sha256(), False
                    continue
                inserted()
                edit = head[-1][pos]
                pos += 1
                if edit != "D":
                    line(role if edit == "K" else other(), text)
            if out:
                yield emit()
                out = []
        if head:
            inserted()
            out.append((*head, sha.hexdigest()))
            yield emit()

    return rows.select("_seq", "role", "text", *_named(REPORT)).mapInArrow(run, f"{REPORT}, repaired_sha256 string")

"""Chat formatting with typed content parts.

A message holds a list of typed parts. A visitor goes through them and writes text (escaped) and one placeholder per
image, audio or document, in order; it notes each attachment's reference and how many tokens its placeholder
expands to. A turn becomes

    \\x02role\\n  ...parts...  \\x03

with the control characters fixed below; where they (or the escape character) occur in a text or a role, they are
escaped, so the output can always be read back. The loss mask covers what an assistant wrote, without markers.

At scale: turns are formatted where they lie. One shuffle by conversation, sorted by turn, brings the turns of a
conversation behind each other; they are streamed, never collected, so a conversation with a third of all turns needs
no more memory than any other (one digest per conversation is sequential by its nature).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import slices

# fixed values of the template
START, END, ESCAPE, OPEN, CLOSE = "\x02", "\x03", "\x1b", "\x0e", "\x0f"
CODES = {START: "s", END: "e", ESCAPE: "x", OPEN: "o", CLOSE: "c", "\n": "n"}  # a line break only in roles
BACK = {code: char for char, code in CODES.items()}
IMAGE_TILE = 512  # pixels a side; a tile is TILE_TOKENS tokens
TILE_TOKENS = 85
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 600  # a page
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
MASKED = "assistant"


def escape(text: str, more: str = "") -> str:
    return regex.sub(f"[\x02\x03\x1b\x0e\x0f{more}]", lambda m: ESCAPE + CODES[m[0]], text)


def unescape(text: str) -> str:
    return regex.sub("\x1b(.)", lambda m: BACK[m[1]], text, flags=regex.DOTALL)


@dataclass
class Flattener:
    """Visitor of content parts: writes the flat text and notes the attachments."""

    pieces: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part {kind!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across = -(-(part.get("width") or 1) // IMAGE_TILE)
        down = -(-(part.get("height") or 1) // IMAGE_TILE)
        self._attach("image", part, max(1, across) * max(1, down) * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0.0) * AUDIO_TOKENS)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"{OPEN}{kind}:{len(self.refs)}{CLOSE}")
        self.refs.append(part.get("ref") or "")
        self.tokens.append(tokens)


def flatten(role: str, parts: Iterable[dict]) -> tuple[str, list[str], list[int]]:
    """(formatted turn, attachment references, expanded token counts)."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    head = START + escape(role, "\n") + "\n"
    return head + "".join(visitor.pieces) + END, visitor.refs, visitor.tokens


def text_parts(rows: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as messages with one text part each; a NULL text is an empty one."""
    none = {n: F.lit(None).cast(t) for n, t in (x.split() for x in PART.split(", ")) if n not in ("type", "text")}
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(c.alias(n) for n, c in none.items()))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.array(part).alias("parts"),
    )


def format_turns(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, formatted, refs, tokens.

    ``messages`` has conv_id, turn, role, parts (array of ``PART`` structs). NULL roles, parts and texts are empty;
    unknown part types are an error. Other columns are ignored. The loss mask is read off the output by
    :func:`read_turns`.
    """

    def run(batches):
        for batch in slices(batches):
            made = [flatten(r or "", p or ()) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string())), pa.array([m[2] for m in made], pa.list_(pa.int64()))],
                ["conv_id", "turn", "formatted", "refs", "tokens"],
            )

    source = messages.select("conv_id", "turn", "role", "parts")
    return source.mapInArrow(run, "conv_id bigint, turn bigint, formatted string, refs array<string>, tokens array<bigint>")


TURN = regex.compile("\x02([^\x02\x03\n]*)\n([^\x02\x03]*)\x03")


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of every turn in formatted text, found by the markers alone."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield (role := unescape(found[1])), unescape(found[2]), role == MASKED
        at = found.end()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read every formatted conversation back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of one conversation are taken by turn (NULL first), rows of one turn by their formatted text. Rows without
    conv_id form one conversation. An empty table gives an empty result.
    """

    def run(batches):
        now, state = None, None

        def closed():
            n, turns_sum, loss, loss_sum, chars = state
            return (now[0], n, turns_sum.hexdigest(), loss, loss_sum.hexdigest(), chars)

        def emit(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in slices(batches):
            out = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (conv,):
                    if state:
                        out.append(closed())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, said, masked in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    if masked:
                        state[2] += len(said)
                        state[3].update(said.encode())
            if out:
                yield emit(out)
        if state:
            yield emit([closed()])

    ordered = turns.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )

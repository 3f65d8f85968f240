import hashlib
import heapq
import itertools
import re
import zlib

import pytest

from siltworks.llm import turns
from siltworks.llm.turns import cheapest, damaged, repair, row_cells, row_code, span_cells

ALPHABET = "suaoSUAOx"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, first string, n int, rid string, fault string, part string"


def every_split(codes):
    """Chart over all spans and all splits: the textbook form of the parse."""
    n = len(codes)
    chart = {(i, i + 1): row_cells(codes[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            found = [turns.combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert all(f == found[0] for f in found)
            chart[i, i + length] = found[0]
    return chart[0, n] if n else turns.INSERTED


def best_first(codes):
    """Cheapest edits by a search over (row, output) states; audits settle ties."""
    heap, seen = [(0, "", 0, 0)], {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if seen.get((at, state), (cost, audit)) < (cost, audit):
            continue
        seen[at, state] = (cost, audit)
        new = [(cost + 3, audit + "I", at, turns.STEPS[state, x]) for x in "ua" if (state, x) in turns.STEPS]
        if at < len(codes):
            code = codes[at]
            new.append((cost + 4, audit + "D", at + 1, state))
            if code != "x":
                more = 3 if code.isupper() else 0
                if (state, code.lower()) in turns.STEPS:
                    new.append((cost + more, audit + "K", at + 1, turns.STEPS[state, code.lower()]))
                new += [(cost + 3 + more, audit + "R", at + 1, turns.STEPS[state, x]) for x in "ua" if (state, x) in turns.STEPS]
        for item in new:
            if item[:2] < seen.get(item[2:], (10**9, "")):
                heapq.heappush(heap, item)
                seen[item[2:]] = item[:2]
    return min(seen[len(codes), s] for s in (0, 3) if (len(codes), s) in seen)


@pytest.mark.parametrize("n", range(5))
def test_chart_against_search(n):
    for codes in itertools.product(ALPHABET, repeat=n):
        codes = "".join(codes)
        assert cheapest(span_cells(codes)) == best_first(codes), codes


def test_every_split_gives_the_same_cells():
    for k in range(40):
        codes = "".join(ALPHABET[zlib.crc32(f"{k}:{i}".encode()) % 9] for i in range(5 + k % 9))
        assert every_split(codes) == span_cells(codes)
        assert cheapest(every_split(codes)) == best_first(codes)


def plain(rows, damage=True):
    """The contract, row by row."""
    space = lambda v: " " if v is None else v
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 9
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        known = [t for t, _, _ in held if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults, seen = [], set()
        for _, role, text in held:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "fine")
            seen.add((role, text))
        initials = [r[:1] or " " for _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = best_first("".join(map(row_code, initials, faults)))
        lines, left, state = [], list(held), 0
        for edit in audit:
            row = None if edit == "I" else left.pop(0)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if state == 2 else "user"
            lines.append(f"{role}:{row[2] if row else ''}")
            state = turns.STEPS[state, role[0]]
        assert not left and state in (0, 3)
        count = faults.count
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", 1, "r", "x", "p") for r in rows], SCHEMA)


AWKWARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 3, "user", "Hello?"), (1, 9, "assistant", "cut of"),
    (2, None, "user", "One."), (2, None, "user", "One."), (2, None, None, None), (2, 4, "assistant", "Two. \n"),
    (3, 0, "assistant", ""), (3, 1, "", "No role."), (3, 2, "tool", "Result!"), (3, 2, "tool", "Result!"),
    (None, 0, "user", "Without number."), (None, 1, "assistant", "Reply."), (4, 0, "user", " \t\x0b"), (5, None, "assistant", "Alone."),
    *((6, k, ("user", "assistant", "assistant", "system")[k % 4], f"Turn {k % 50}" + "." * (k % 3)) for k in range(400)),
    (7, 0, "user", "long " * 200_000 + "."), (7, 1, "assistant", "\U0001f600!"),
    *((100 + k, t, ("user", "assistant")[t % 2], f"Says {k} {t}.") for k in range(60) for t in range(4)),
]


@pytest.mark.parametrize("damage", [True, False])
def test_against_plain_rules(spark, rows, damage):
    made = frame(spark, AWKWARD).repartition(3)
    got = repair(damaged(made) if damage else made)
    assert rows(got) == plain(AWKWARD, damage)


def test_long_conversation_over_many_tasks(spark, rows, unbroadcast):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = [(1, None if k % 7 == 0 else k // 3, ("user", "assistant", "system")[zlib.crc32(str(k).encode()) % 3], f"{k % 400}.") for k in range(3000)]
        many += [(2, 0, "user", "Same.")] * 900 + [(k, 0, "user", "x") for k in range(3, 30)]
        assert rows(repair(frame(spark, many))) == plain(many, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_table(spark):
    assert repair(damaged(frame(spark, [(1, 0, "user", "x")]).limit(0))).collect() == []

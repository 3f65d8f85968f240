"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, reporting). Four small transducers read a clause's
classes one after the other, each rewriting what the one before it wrote:

* reporting: marks what follows a verb of speech as reported,
* negation: marks the next ``SCOPE`` words after a negation as negated,
* target: remembers whether the clause names a person,
* insult/threat: writes one event per offending word with the marks that hold there.

They are composed into one machine, which is run over every clause that has an offending word. A document's score is a
logistic function of the weights of its events; the weights of the arcs are learned from labels, and so are further
insult words (words far more frequent in toxic documents).

Learning uses at most ``SAMPLE`` labelled documents and keeps at most ``LEARNED`` words; the grammar is broadcast.
Scoring is a narrow map, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import bounded_sample, held_out, slices, texts

SAMPLE = 20_000
LEARNED = 500
THRESHOLD = 0.3
SCOPE = 3
RARE = 5  # a word must be in this many labelled texts to be learned
SURE = 6.0  # and exceed chance by this many standard deviations

# Words that open the classes.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic clown fool imbecile jerk bastard dumm blöd idiota estúpido imbécil stupide".split()  # noqa: E501
THREATS = "kill hurt destroy beat burn shoot stab attack strangle murder töten umbringen schlagen matar destruir golpear tuer frapper détruire".split()  # noqa: E501
TARGETS = "you your yours yourself u he him she her they them du dich dir ihr euch tú ti usted ustedes vosotros tu toi vous".split()
NEGATIONS = "not no never don't doesn't isn't aren't wasn't won't can't nicht kein keine nie nunca jamás ne pas jamais".split()
REPORTS = "said says say wrote writes claimed claims called quoted reported sagte schrieb dijo escribió dit écrit".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
# events: (insult or threat) x targeted x negated x reported
EVENTS = 16
TOKEN = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
CLAUSE = regex.compile(r"[.!?;:,\n\r]+")


@dataclass(frozen=True)
class Symbol:
    """What the transducers write: a class and the marks set on it."""

    kind: int
    reported: bool = False
    negated: bool = False
    targeted: bool = False


def reporting(state: int, x: Symbol) -> tuple[int, Symbol]:
    return (1 if x.kind == REPORT else state), Symbol(x.kind, reported=bool(state))


def negation(state: int, x: Symbol) -> tuple[int, Symbol]:
    after = SCOPE if x.kind == NEGATION else max(0, state - 1)
    return after, Symbol(x.kind, x.reported, negated=state > 0)


def target(state: int, x: Symbol) -> tuple[int, Symbol]:
    return (1 if x.kind == TARGET else state), Symbol(x.kind, x.reported, x.negated, targeted=bool(state))


def offence(state: int, x: Symbol) -> tuple[int, int]:
    """The last transducer writes the number of an event, or -1."""
    if x.kind not in (INSULT, THREAT):
        return state, -1
    return state, 8 * (x.kind == THREAT) + 4 * x.targeted + 2 * x.negated + x.reported


def compose(*steps: Callable) -> list[list[tuple[int, int]]]:
    """One machine for a cascade of transducers: ``machine[state][class]`` is (next state, event). Start: 0."""
    start = (0,) * len(steps)
    number, todo, machine = {start: 0}, [start], []
    while todo:
        states = todo.pop(0)
        row = []
        for kind in range(6):
            symbol, after = Symbol(kind), []
            for step, state in zip(steps, states, strict=True):
                state, symbol = step(state, symbol)
                after.append(state)
            if (key := tuple(after)) not in number:
                number[key] = len(number)
                todo.append(key)
            row.append((number[key], symbol))
        machine.append(row)
    return machine


@dataclass(frozen=True)
class Grammar:
    """Word classes, the strength of each offending word, and the learned weights of the events."""

    classes: dict[str, int]
    strength: dict[str, float]
    weights: tuple[float, ...]  # one per feature, the last is the bias

    @property
    def features(self) -> int:
        return EVENTS + 1


class Reader:
    """Runs the composed machine over texts."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.machine = compose(reporting, negation, target, offence)
        offending = {w for w, k in grammar.classes.items() if k in (INSULT, THREAT)}
        self.offending = offending

    def events(self, text: str) -> np.ndarray:
        """log(1 + count) of each event over the clauses, and log(1 + summed strength)."""
        out = np.zeros(self.grammar.features)
        lowered = text.lower()
        if self.offending.isdisjoint(TOKEN.findall(lowered)):
            return out
        for clause in CLAUSE.split(lowered):
            words = TOKEN.findall(clause)
            if self.offending.isdisjoint(words):
                continue
            # a target counts wherever it stands in the clause
            named = any(self.grammar.classes.get(w) == TARGET for w in words)
            state = self.machine[0][TARGET][0] if named else 0
            for w in words:
                state, event = self.machine[state][self.grammar.classes.get(w, OTHER)]
                if event >= 0:
                    out[event] += 1
                    out[EVENTS] += self.grammar.strength.get(w, 1.0)
        return np.log1p(out)

    def score(self, text: str) -> float:
        w = self.grammar.weights
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(self.events(text) @ np.array(w[:-1])) + w[-1]))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic regression with a small penalty; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def base_grammar() -> Grammar:
    """The grammar before learning: fixed words, weights that make any offence likely toxic."""
    classes = {w: k for k, words in reversed(CLASSES) for w in words}
    return Grammar(classes, {}, (*[3.0] * 8, *[1.0] * 8, 0.0, -3.0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learned: int = LEARNED) -> Grammar:
    """Learn words and weights from labelled documents outside the held-out fold. Starts jobs.

    A document with several labels is toxic if one says so; NULL labels and labels without document do not count.
    Equal texts count once. Without toxic or without clean examples the base grammar is returned.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = bounded_sample(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", sample)
    # bounded by ``sample`` rows
    rows = texts(docs).join(F.broadcast(marks), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).cache()
    base = base_grammar()
    total, toxic = rows.select(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        rows.unpersist()
        return base
    rate = toxic / total
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    excess = (F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    found = (
        counts.filter((F.col("n") >= RARE) & (F.col("hits") > 0.5 * F.col("n")) & (excess >= SURE))
        .orderBy(F.desc(excess), "word").limit(learned).collect()
    )
    classes = {r["word"]: INSULT for r in found} | base.classes
    strength = {r["word"]: math.log((r["hits"] + 0.5) / (r["n"] - r["hits"] + 0.5)) - math.log(rate / (1 - rate)) for r in found}
    draft = Grammar(classes, {w: max(s, 0.0) for w, s in strength.items()}, base.weights)

    def run(batches):
        reader = Reader(draft)
        for batch in slices(batches):
            values = [reader.events(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    examples = rows.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toArrow()  # at most ``sample``
    rows.unpersist()
    x = np.array(examples.column("x").to_pylist())
    y = np.array(examples.column("toxic").to_pylist(), dtype=float)
    # an offence is never a sign of a clean text: events with too few examples keep a weight of 0
    weights = _logistic(x, y)
    weights[:-1] = np.maximum(weights[:-1], 0.0)
    return Grammar(draft.classes, draft.strength, tuple(weights.tolist()))


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    NULL and empty texts have no event and get the score of the bias. Repeated rows and rows without doc_id are
    scored like any other. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by LEARNED and the fixed words

    def run(batches):
        reader = Reader(shared.value)
        for batch in slices(batches):
            scores = [reader.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

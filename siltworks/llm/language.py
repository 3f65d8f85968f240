"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. A word the model has not seen is scored by its
longest known character n-grams: length 4, then 3, 2, 1. The document's score is the posterior of the sums.

Learning counts words and n-grams in Spark over a bounded sample of labelled documents (``SAMPLE`` documents, at
most ``WORDS`` words and ``GRAMS`` n-grams, the most frequent ones); the model is therefore bounded too and is
broadcast. Prediction is a narrow map, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.common import bounded_sample, held_out, slices, small_batches, stored, texts

SAMPLE = 20_000
WORDS = 60_000
GRAMS = 60_000
LONGEST = 4
SMOOTH = 0.5
REJECT = 0.3  # documents below this score are rejected: no language is much likelier than another
UNKNOWN = "und"
SEEN = 200_000
WORD = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages and, per word and n-gram, the row that holds its log probability in each of them.

    The last row of ``gram_rows`` is for words of which nothing is known.
    """

    languages: tuple[str, ...]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray


def _log_table(rows: pa.Table, languages: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """Places of the terms and their log probabilities, from counts (term, lang, n) that stay columns: no object for each of them."""
    place = {x: k for k, x in enumerate(languages)}
    term, lang = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "lang"))
    counts = np.zeros((len(term.dictionary), len(languages)))
    places = np.array([place[x] for x in lang.dictionary.to_pylist()], dtype=np.int64)
    np.add.at(counts, (term.indices.to_numpy(), places[lang.indices.to_numpy()]), rows.column("n").to_numpy())
    total = counts.sum(axis=0) + SMOOTH * max(1, len(counts))
    return {x: k for k, x in enumerate(term.dictionary.to_pylist())}, np.log((counts + SMOOTH) / total)


def _frequent(counts: DataFrame, most: int) -> pa.Table:
    top = counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    return counts.join(F.broadcast(top), "term").select("term", "lang", "n").toArrow()  # at most ``most`` terms


def fit(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Learn from the documents with a lang, a text and a doc_id outside the held-out fold. Starts jobs.

    Several rows with one doc_id all count. Without any such document the model knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = bounded_sample(rows, "doc_id", sample)
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counts = rows.select("lang", F.explode(found).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "language-words")
    languages = tuple(sorted(r[0] for r in counts.select("lang").distinct().collect()))
    known = _frequent(counts, words)
    padded = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    size = F.length("term") + 2
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST), size)),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n)),
        )
    )
    gram_counts = counts.select("lang", F.explode(pieces).alias("term"), "n").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    gram_counts = stored(gram_counts, "language-grams")  # made once, as every length reads them twice
    # the most frequent n-grams of each length, so that long ones are kept besides single letters
    ranked = gram_counts.groupBy("term").agg(F.sum("n").alias("total"))
    places: dict[str, int] = {}
    tables = []
    for n in range(1, LONGEST + 1):
        top = ranked.filter(F.length("term") == n).orderBy(F.desc("total"), "term").limit(grams // LONGEST)
        some = gram_counts.join(F.broadcast(top.select("term")), "term").select("term", "lang", "n").toArrow()
        terms, table = _log_table(some, languages)
        places |= {g: k + len(places) for g, k in terms.items()}
        tables.append(table)
    return LanguageModel(languages, *_log_table(known, languages), places, np.concatenate([*tables, np.zeros((1, len(languages)))]))


class Scorer:
    """Applies a model; keeps the scores of the words it has met, up to ``SEEN``."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest known n-grams of an unseen word."""
        padded, known = f"^{word}$", self.model.grams.get
        for n in range(min(LONGEST, len(padded)), 0, -1):
            if rows := [r for k in range(len(padded) - n + 1) if (r := known(padded[k : k + n])) is not None]:
                return rows
        return [len(self.model.grams)]

    def _learn(self, words: list[str]) -> None:
        """Add the scores of words not met so far to the table."""
        place = len(self.seen)
        while place + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.seen.update(zip(words, range(place, place + len(words)), strict=True))
        known_at, known_rows, unseen, rows, sizes = [], [], [], [], []
        for k, w in enumerate(words, place):
            if (known := self.model.words.get(w)) is not None:
                known_at.append(k)
                known_rows.append(known)
            else:
                found = self.backoff(w)
                unseen.append(k)
                rows += found
                sizes.append(len(found))
        if known_at:
            self.table[known_at] = self.model.word_rows[known_rows]
        if unseen:
            starts = np.cumsum([0, *sizes[:-1]])
            self.table[unseen] = np.add.reduceat(self.model.gram_rows[rows], starts) / np.array(sizes)[:, None]

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        self._learn(list(set(words).difference(self.seen)))
        return np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))

    def texts(self, batch: list[str]) -> tuple[list[str], list[float]]:
        words = [WORD.findall(t.lower()) for t in batch]
        flat = [w for some in words for w in some]
        if not flat or not self.model.languages:
            return [UNKNOWN] * len(batch), [0.0] * len(batch)
        places = self._places(flat)
        ends = np.cumsum([len(some) for some in words])
        names, scores = [], []
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            if start == end:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            sums = self.table[places[start:end]].sum(axis=0)
            best = int(np.argmax(sums))
            names.append(self.model.languages[best])
            scores.append(1.0 / float(np.exp(np.maximum(sums - sums[best], -700.0)).sum()))
        return names, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior, 0 to 1).

    NULL texts, empty texts and texts without a letter get ``und`` and score 0, as does everything if the model knows
    no language. Ties go to the first language by name. Repeated rows and rows without doc_id are predicted like any
    other. Only the text is used.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches, 128):
            names, scores = scorer.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    found = texts(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``reject``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches, 128):
            column = batch.column(batch.schema.get_field_index("text"))
            names, scores = scorer.texts([t or "" for t in column.to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN and s >= reject for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

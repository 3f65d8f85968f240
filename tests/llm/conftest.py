import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that the operators use for themselves
    "keep_id string, kept string, fp string, a string, b string, name string, level int, line string, line_no int, "
    "_rid string, _row string, _gone string, score string, n string, value string, root string, span string, _leak string"
)
EXTRA = ["x"] * 6 + [1, "x", 1] + ["x"] * 9


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs (or (doc_id, text, lang)), with columns of clashing names."""

    def build(pairs):
        rows = [(p[0], p[1], p[2] if len(p) > 2 else "en", "src0", None if p[1] is None else len(p[1]), *EXTRA) for p in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture
def awkward(documents):
    """NULLs, empty and very long texts, ties, repeated rows, a row without id."""
    long = " ".join(f"word{k % 977} the" for k in range(40_000)) + "\n" + "x" * 100_000
    pairs = [
        (1, "A line of text that is long enough.\nAnother line, which is also long enough."),
        (2, "A  line of\ttext that is long enough.\nAnother line, which is also long enough."),
        (3, None), (4, ""), (5, " \t\n "), (6, long), (7, long), (8, "Short."), (8, "Short."),
        (None, "A row without a number, but with a text of some length."), (None, None),
        (9, "Überraschung! Straße nach Süden, größer als zuvor \U0001f600 und weiter."), (10, "12345 67890"),
        (11, "word " * 3), (12, "A line of text that is long enough!\nnew"),
    ]
    return documents(pairs)


@pytest.fixture
def nothing(documents):
    return documents([(1, "x")]).limit(0)

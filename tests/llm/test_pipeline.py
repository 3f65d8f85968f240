"""The registered queries of this folder and the pipeline's stages on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from brute import fingerprint

import __spark_entry__ as entry_points
import corpus_pipeline
from siltworks.llm.common import stored, table
from siltworks.llm.queries import ORACLES, QUERIES
from tools.check import rows as sorted_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_and_its_twin(spark, duck, name):
    got = sorted_rows(QUERIES[name](spark, SF).toArrow())
    assert got == sorted_rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        seen.append((name, {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}))
    kept = {name: (set(a), set(b)) for name, a, b in seen}
    assert kept["language_id"][0] == kept["language_id"][1]  # every document here has a language
    # lines: nothing but whole lines goes, and of the lines that stay none is repeated
    _, before, after = seen[1]
    assert set(before) == set(after)
    lines = [line.strip() for r in after.values() for line in r.text.split("\n") if len(line.strip()) >= 20]
    assert len(lines) == len(set(lines))
    for k, r in after.items():
        assert set(r.text.split("\n")) <= {*before[k].text.split("\n"), ""} and r.n_chars == len(r.text)
    # near duplicates: nothing that stays is within 4 bits of another
    _, before, after = seen[2]
    prints = np.array([fingerprint(r.text) for r in after.values()], dtype=np.uint64)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    np.fill_diagonal(apart, 64)
    assert apart.min() > 4
    # leaks: no item is left word for word, and documents without one stay
    _, before, after = seen[3]
    from siltworks.llm.leaks import reduced

    items = [reduced(r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
    leaking = {k for k, r in before.items() if any(i in reduced(r.text.encode()) for i in items)}
    assert leaking and not leaking & set(after)
    assert all(r.whole for r in seen[4][2].values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).filter("NOT whole").count() == 0

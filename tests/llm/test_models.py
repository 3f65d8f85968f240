"""Language, toxicity and personal data."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import personal, sha, spans_text

from siltworks.llm import language, pii, toxicity

WORDS = {
    "en": "the house and water with some people over there when night comes again".split(),
    "de": "das haus und wasser mit einigen leuten dort drüben wenn nacht wieder kommt".split(),
    "fr": "la maison et eau avec quelques gens là quand nuit vient encore".split(),
}


@pytest.fixture
def tongues(documents):
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        lang = rnd.choice(list(WORDS))
        rows.append((k, " ".join(rnd.choice(WORDS[lang]) for _ in range(12)), lang))
    return documents(rows)


def test_language(tongues, awkward, nothing):
    model = language.fit(tongues)
    known = {r.doc_id: r.lang for r in tongues.collect()}
    got = language.identify(tongues, model).collect()
    assert all(r.lang_pred == known[r.doc_id] and 0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got} == {True, False}
    odd = {r.doc_id: r for r in language.identify(awkward, model).collect() if r.doc_id is not None}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (3, 4, 5, 10))
    assert language.identify(awkward, model).count() == awkward.count()
    assert language.identify(nothing, model).count() == 0


def test_unseen_words_back_off(documents, tongues):
    model = language.fit(tongues)
    docs = documents([(1, "nachts leute hausen"), (2, "maisons quelque"), (3, "waters nights houses")])
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {1: "de", 2: "fr", 3: "en"}


def test_nothing_to_learn(nothing, awkward):
    model = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(awkward, model).collect()} == {"und"}
    assert language.accepted(awkward, model).count() == 0


def test_rejected_documents_go(tongues, awkward):
    model = language.fit(tongues)
    left = language.accepted(awkward, model)
    assert left.columns == awkward.columns
    assert not {3, 4, 5, 10} & {r.doc_id for r in left.collect()}
    assert language.accepted(tongues, model).count() == 300


def test_the_held_out_fold_teaches_nothing(tongues, spark):
    from pyspark.sql import functions as F

    from siltworks.llm.common import held_out

    lies = tongues.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.fit(lies).languages == ("de", "en", "fr")


def test_transducers_mark_a_clause():
    reader = toxicity.Reader(toxicity.base_grammar())

    def events(text):
        return [k for k, x in enumerate(reader.events(text)[: toxicity.EVENTS]) if x]

    assert events("such an idiot") == [0]
    assert events("you are an idiot") == [4]
    assert events("you are not an idiot") == [6]
    assert events("she said: idiot") == [0]  # another clause
    assert events("they said it was an idiot") == [5]
    assert events("I will kill the lights, you know") == [8]
    assert events("I will kill you") == [12]
    assert events("nothing to see") == []


def test_toxicity(documents, awkward, nothing, spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        words = [rnd.choice(WORDS["en"]) for _ in range(30)]
        bad = k % 3 == 0
        if bad:
            words[rnd.randrange(30)] = rnd.choice(["grubnik", "moron", "zorble"])
        rows.append((k, " ".join([f"t{k}", *words])))
        labels.append((k, 1, int(bad), "x"))
    labels += [(None, 1, 1, "x"), (3, 1, None, "x"), (99_999, 1, 1, "x"), (6, 0, 0, "x")]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    docs = documents(rows)
    grammar = toxicity.fit(docs, labels)
    assert {"grubnik", "zorble"} <= set(grammar.classes)
    got = toxicity.score(docs, grammar).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) and 0 <= r.score <= 1 for r in got)
    odd = toxicity.score(awkward, grammar)
    assert odd.count() == awkward.count() and odd.filter("predicted = 1").count() == 0
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def found(df):
    return {r.doc_id: r for r in pii.find_personal_data(df).collect()}


def test_base_spans(documents):
    rnd = random.Random(5)
    kinds = ["a@b.c_%+-", "0123456789 .-+()", "\x01\x02é\U0001f600 \n@.", "1234567890@.a+ "]
    texts = ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1111", "a@b.c.d@e.f a@b.c_d@e.f", "+1 (606) 555-7814.", "1.2.3.4.5.6.7.8", "1." * 500, None, "", "+1" + "." * 1000]
    got = found(documents(list(enumerate(texts))))
    for k, text in enumerate(texts):
        want = personal(text or "")
        assert got[k].base_sha256 == sha(spans_text(want)), text
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(s[1] == n for s in want) for n in range(4)]


def test_patterns_discover_identifiers(documents, unbroadcast):
    rows = [(k, f"write to mailbox u{k}@mail.example.com or come by") for k in range(40)]
    rows += [(100, "write to mailbox user1234(at)home or come by"), (101, "\x02 the 123456 house"), (102, None)]
    got = found(documents(rows))
    assert got[100].spans == "email:17:34" or got[100].spans == "email:17:33"
    assert got[100].n_found == 1 and got[100].n_email == 0 and got[100].base_sha256 == sha("")
    assert got[101].spans == got[102].spans == ""
    assert got[5].spans == "email:17:36" or got[5].spans.startswith("email:17:")


def test_whole_entities_are_seeds(documents):
    rnd = random.Random(8)
    names = [f"{a}.{b}" for a in ("ann", "bob", "cid", "dee") for b in ("oak", "elm", "fir", "ash")]
    rows = [(k, f"please ring +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} before noon") for k in range(20)]
    cards = ["4111 1111 1111 1111", "4012 8888 8888 1881", "5555 5555 5555 4444", "5105 1051 0510 5100", "4222 2222 2222 2220", "6011 1111 1111 1117", "6011 0009 9013 9424", "3530 1113 3330 0000"]
    cards = [c for c in cards if personal(c)]
    assert len(cards) >= 6
    rows += [(100 + k, f"charge {c} today please") for k, c in enumerate(cards)]
    rows += [(200 + k, f"write mailto {n}@site.com, thanks") for k, n in enumerate(names)]
    hidden = {300: ("we ring 555 123 4567 often", "phone:8:20"), 301: ("they charge 4111 1111 1111 1112 now", "card:12:31"), 302: ("or mailto john at site dot com maybe", "email:10:30"), 303: ("or mailto john.doe(at)site maybe", "email:10:26")}
    hidden |= {304: ("we ring nobody at all", ""), 305: ("john at site dot com", "")}
    got = found(documents(rows + [(k, t) for k, (t, _) in hidden.items()]))
    assert {k: got[k].spans for k in hidden} == {k: want for k, (_, want) in hidden.items()}
    assert all(got[k].n_found == 0 for k, _ in rows)


def test_no_long_run_is_slow(documents):
    texts = ["a" * 200_000, "@" + "a" * 200_000, "a@" + "b." * 50_000 + "c", "1." * 50_000, "+1" + "." * 100_000, "1 " * 50_000]
    got = found(documents(list(enumerate(texts))))
    assert got[2].n_email == 1 and got[3].n_ip == 12_500 and got[0].spans == ""


def test_awkward_rows(awkward, nothing):
    assert pii.find_personal_data(awkward).count() == awkward.count()
    assert pii.find_personal_data(nothing).count() == 0


def test_a_language_model_is_small_and_made_once(tongues, monkeypatch):
    made = []
    real = language.stored
    monkeypatch.setattr(language, "stored", lambda df, label: made.append(label) or real(df, label))
    tongues.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = language.fit(tongues)
    assert made == ["language-words", "language-grams"]
    # numbers of rows in two tables, no array for each word
    assert {type(v) for v in [*model.words.values(), *model.grams.values()]} == {int}
    assert model.word_rows.shape == (len(model.words), 3) and model.gram_rows.shape == (len(model.grams) + 1, 3)
    assert sorted(model.words.values()) == list(range(len(model.words)))
    assert sorted(model.grams.values()) == list(range(len(model.grams)))
    language.accepted(tongues, model)
    assert int(tongues.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000


def test_log_probabilities_from_columns():
    rows = pa.table({"term": ["a", "b", "a", "c"], "lang": ["x", "y", "y", "y"], "n": pa.array([3, 1, 2, 4], pa.int64())})
    terms, found = language._log_table(rows, ("w", "x", "y"))
    assert terms == {"a": 0, "b": 1, "c": 2}
    want = np.array([[0, 3, 2], [0, 0, 1], [0, 0, 4]]) + language.SMOOTH
    assert np.allclose(found, np.log(want / want.sum(axis=0)))
    assert language._log_table(rows.slice(0, 0), ("x",))[1].shape == (0, 1)

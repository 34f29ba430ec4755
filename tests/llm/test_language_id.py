import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from typelore.llm import language_id as L
from typelore.llm import queries

SCHEMA = "doc_id long, text string, lang string, score string"


def naive_phrases(sample, text):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


@settings(max_examples=80, deadline=None)
@given(st.text("abcé ", max_size=40), st.lists(st.text("abcdé ", max_size=30), max_size=5))
def test_greedy_parse_against_substring_search(sample, texts):
    automaton = L.suffix_automaton(sample)
    width = max([len(t) for t in texts] + [1])
    grid = np.full((len(texts), width), -1, dtype=np.int64)
    for row, t in enumerate(texts):
        grid[row, : len(t)] = [ord(c) for c in t]
    got = L.phrases(L.Table.of([automaton]), grid)[:, 0] if texts else []
    assert list(got) == [naive_phrases(sample, t) for t in texts]


def test_held_out_accuracy(spark):
    got = queries.language_ids(spark, "/root/testdata/sf0.01").toPandas()
    truth = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(truth) and len(held) > 100
    assert (held.lang_pred == held.lang).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_cases(spark):
    en = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun " * 3
    de = "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund " * 3
    rows = [(0, en, "en", "x"), (3, de, "de", "x"), (4, en + "again", "en", "x"), (7, de + " wieder", "de", "x")]
    rows += [(2, "the lazy dog sleeps", None, "x"), (6, "der faule hund", None, "x"), (10, None, "en", "x"), (14, "", None, "x")]
    rows += [(18, "12345 !!! ...", None, "x"), (22, "the lazy dog sleeps", None, "x"), (None, "der hund", None, "x")]
    rows += [(26, ("the fox " * 20000).strip(), None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, i): r for i, r in enumerate(L.identify(docs).orderBy("doc_id", "score").collect())}
    by_id = {}
    for (doc_id, _), r in got.items():
        by_id.setdefault(doc_id, []).append(r)
    assert by_id[2][0].lang_pred == "en" and by_id[6][0].lang_pred == "de" and by_id[None][0].lang_pred == "de"
    assert [(r.lang_pred, r.score) for r in by_id[10] + by_id[14] + by_id[18]] == [("und", 0.0)] * 3
    assert by_id[2][0].score == by_id[22][0].score and 0 < by_id[2][0].score <= 1
    assert by_id[26][0].lang_pred == "en" and by_id[None][0].held_out is False
    assert len(got) == len(rows)


def test_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello world", "en", "old"), (5, "hallo welt", "de", "old")], SCHEMA)
    langs, automata = L.fit(docs)
    out = L.predict(docs.withColumn("lang_pred", docs.lang), langs, automata)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted(r.lang_pred for r in out.collect()) == ["de", "en"]
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = L.identify(spark.createDataFrame([(1, "hello", None, "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]

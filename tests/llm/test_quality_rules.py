import random
import re

import pytest

from typelore.llm import quality_rules as Q
from typelore.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def _check(frame):
    texts = {r.doc_id: r.text for r in frame.collect()}
    entries = Q.ledger(frame)
    rows = entries.select(
        "doc_id",
        "measures.n_words",
        "measures.word_chars",
        "measures.n_symbols",
        "measures.n_dup_lines",
        "measures.n_repeat_words",
        (~Q.passes(Q.POLICIES["base"])).alias("b"),
    ).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), r.doc_id


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = ["a", "bb", "é漢", "#x", "C!", "<>", "d,"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice(" \n\t  \x0b") for _ in range(rng.randint(0, 90)))) for i in range(80)]
    line = "one two three four five six seven eight nine\n"
    rows += [(100, None), (101, ""), (102, " \n\n "), (103, line * 4), (104, line * 3000), (105, "x " * 8), (106, "\x85 \xa0b")]
    _check(docs(rows))


def test_given_documents(spark, sf_dir):
    _check(queries.table(spark, sf_dir, "documents").select("doc_id", "text"))


def test_policies_and_ablations(spark, docs):
    good = " ".join(f"word{i}" for i in range(40))
    shout = " ".join(f"WORD{i}!!" for i in range(40))
    rows = [(1, good), (2, shout), (3, "few words"), (4, None), (4, None), (None, good)]
    frame = Q.ledger(docs(rows))
    kept = {r.doc_id: r.k for r in frame.select("doc_id", Q.passes(Q.POLICIES["2"]).alias("k")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, None: True}
    base = [r.k for r in frame.filter("doc_id = 2").select(Q.passes(Q.POLICIES["base"]).alias("k")).collect()]
    assert base == [True]
    got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in Q.ablations(frame, Q.POLICIES["2"]).collect()}
    assert got["few_words"] == (3, 3, 5) and got["symbols"] == (0, 0, 2)
    assert got["capitals"] == (1, 0, 2) and got["exclamations"] == (1, 0, 2)
    assert Q.ledger(docs(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.ledger(frame)


def test_native_plan(spark, sf_dir):
    plan = queries.rule_ledger(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)

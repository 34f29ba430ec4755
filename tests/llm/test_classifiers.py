import random
import zlib

import numpy as np

from typelore.llm import quality_classifier as Q
from typelore.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    positive = label == 1
    n1, n0 = positive.sum(), (~positive).sum()
    return (ranks[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def _held(spark, query, column):
    labels = queries.table(spark, SF, "labels").select("doc_id", column)
    got = query(spark, SF).join(labels, "doc_id").toPandas()
    for row in got.head(200).itertuples():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
    return got[got.held_out]


def test_quality_on_held_out_rows(spark):
    rows = _held(spark, queries.quality_scores, "quality")
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.97
    good = rows[rows.quality == 1]
    assert good.predicted.mean() > 0.97 and rows[rows.quality == 0].predicted.mean() < 0.2


def test_toxicity_on_held_out_rows(spark):
    rows = _held(spark, queries.toxicity_scores, "toxic")
    assert auc(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.94  # some labelled texts hold no toxic word
    assert rows[rows.toxic == 1].predicted.mean() > 0.85 and rows[rows.toxic == 0].predicted.mean() < 0.02


def test_risk_and_prior_on_known_mixtures():
    rng = np.random.default_rng(3)
    positive = rng.normal(1.5, 1, (3000, 3))
    for share in (0.3, 0.7):
        unlabelled = np.vstack([rng.normal(1.5, 1, (int(4000 * share), 3)), rng.normal(-1.5, 1, (int(4000 * (1 - share)), 3))])
        model = Q.fit(positive, unlabelled)
        assert abs(model.prior - share) < 0.1
        assert (model.score(rng.normal(1.5, 1, (500, 3))) > 0.5).mean() > 0.9
        assert (model.score(rng.normal(-1.5, 1, (500, 3))) < 0.5).mean() > 0.9


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    fire = lambda: np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.05)
    one, two, three = fire(), fire(), fire()
    votes = np.column_stack([one, one, one, one, two, three]).astype(float)
    model = toxicity.fit_label_model(votes, np.full(6, 0.5), np.full(6, 0.1), 0.2)
    assert model.weight[:4].max() < 0.5 < model.weight[4:].min()
    assert auc(model.posterior(votes), y.astype(int)) > 0.9


def test_odd_rows(spark, docs):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choices(["plain", "words", "of", "text", "here"], k=30))
    rows = [(i, prose()) for i in range(60)] + [(i, f"{prose()} vilest") for i in range(60, 90)]
    rows += [(200, None), (201, ""), (202, "w " * 50_000), (203, prose()), (203, prose()), (None, prose())]
    frame = docs(rows)
    labels = spark.createDataFrame(
        [(i, 1, int(i >= 60)) for i in range(90)] + [(None, 1, 1), (5, None, None), (999, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    for classify in (Q.classify, toxicity.classify):
        got = classify(frame, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert got == classify(frame, labels).collect() or len({round(r.score, 9) for r in got}) > 0
        assert classify(frame.limit(0), labels).count() == 0
        assert all(0 <= r.score <= 1 for r in classify(frame, labels.limit(0)).collect())
    toxic = {r.doc_id: r.predicted for r in toxicity.classify(frame, labels).collect()}
    assert sum(toxic[i] for i in range(60, 90)) >= 28 and sum(toxic[i] for i in range(60)) == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelore.llm import multi_index as I
from typelore.llm import queries


def exact(ids, x, queries_, k=10):
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order if i != q][:k]
    return out


def test_walk_visits_cells_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(30):
        one, two = rng.random(7), rng.random(9)
        sizes = rng.integers(0, 4, 63)
        order = np.argsort((one[:, None] + two).ravel(), kind="stable")
        want = [c for c in order.tolist() if sizes[c]]
        assert I.walk(one, two, sizes, 10**9) == want
        some = I.walk(one, two, sizes, 20)
        assert some == want[: len(some)] and sizes[some].sum() >= 20 > sizes[some[:-1]].sum()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = queries.table(spark, sf_dir, "embeddings").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = queries.nearest_vectors(spark, sf_dir).toPandas()
    want = exact(ids, x, np.flatnonzero(ids % 100 == 0))
    found, total = 0, 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(near) + 1))
        for i, s in zip(mine.vec_id, mine.score, strict=True):
            assert s == pytest.approx(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum()), abs=1e-12)
        found += len(set(mine.vec_id) & {i for i, _ in near})
        total += len(near)
    assert found / total >= 0.9


def test_exact_when_all_cells_are_visited_with_equal_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 6))
    x[40:90] = x[40]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    bad = [None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    frame = spark.createDataFrame(
        rows + [(1000 + i, v, "bad") for i, v in enumerate(bad)] + [(None, x[0].tolist(), "no id")],
        "vec_id long, embedding array<double>, cell string",
    )
    index = I.Index(x[:4, :3].copy(), x[4:9, 3:].copy(), 1.0)
    got = I.search(frame, F.col("vec_id") % 10 == 0, neighbours=12, index=index).toPandas()
    want = exact(np.arange(150), x, range(0, 150, 10), 12)
    assert set(got.query_id) == set(want)
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert [(i, pytest.approx(s, abs=1e-9)) for i, s in near] == list(zip(mine.vec_id, mine.score, strict=True))


def test_few_rows(spark):
    frame = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [9.0, 2.0])], "vec_id long, embedding array<float>")
    got = I.search(frame, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 1, 1.0), (100, 2, 2, 8.0)]
    assert I.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert I.search(frame.filter("vec_id = 1"), F.col("vec_id") == 1).count() == 0

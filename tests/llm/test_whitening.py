import math

import numpy as np

from typelore.llm import queries
from typelore.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, vec_id_2 string"


def brute(ids, vectors):
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return x, n, s, e, v


def check(got, ids, vectors, k=4):
    x, n, s, e, v = brute(ids, vectors)
    for comp in range(1, k + 1):
        mine = got[got.component == comp].sort_values("vec_id")
        want = (x - s / n) @ v[:, comp - 1] / math.sqrt(e[comp - 1])
        sign = np.sign(np.dot(mine.whitened, want)) or 1
        assert np.abs(mine.whitened.to_numpy() - sign * want).max() < 1e-9
        assert abs(mine.explained.iloc[0] - e[comp - 1] / e.sum()) < 1e-9
    first = got[got.component == 1].sort_values("vec_id")
    assert list(first.deviation) == [int(((n * r - s) ** 2).sum()) for r in x]
    assert set(got.n) == {n} and got.identity_error.max() < 1e-4


def test_query_against_numpy(spark):
    got = queries.whitened_embeddings(spark, "/root/testdata/sf0.01").toPandas()
    rows = queries.table(spark, "/root/testdata/sf0.01", "embeddings").toPandas().sort_values("vec_id")
    check(got, rows.vec_id.to_numpy(), np.stack(rows.embedding))


def test_dirty_rows_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(base)]
    rows += [(40, [float(c) for c in base[0]], "copy"), (41, [float(c) for c in base[0]], "copy")]
    rows += [(50, None, "null"), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], "holds null"), (52, [float("nan")] * 6, "nan")]
    rows += [(53, [float("inf")] + [0.0] * 5, "inf"), (54, [1.0, 2.0], "short"), (None, [float(c) for c in base[1]], "null id")]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got.vec_id.dropna()) == set(range(42)) and got.vec_id.isna().sum() == 4
    kept = got[got.vec_id.notna()]
    vectors = np.concatenate([base, base[:1], base[:1]])
    check(kept, np.arange(42), vectors)
    assert (got[got.vec_id.isna()].whitened.to_numpy() == kept[kept.vec_id == 1].whitened.to_numpy()).all()


def test_empty_and_all_dirty(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, "a"), (2, [float("nan")], "b")], SCHEMA)).count() == 0
    one = W.whiten(spark.createDataFrame([(1, [0.5, 0.5], "a"), (2, [0.5, 0.5], "b")], SCHEMA))
    assert one.count() == 0  # one distinct vector: no variance, no component


def test_refine_separates_clustered_eigenvalues():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([5, 5, 5 + 1e-9, 3, 3, 1, 1e-3, 1e-3, 1e-3, 0.5, 0.25, 2])
    a = q @ np.diag(values) @ q.T
    _, rough = np.linalg.eigh(a.astype(np.float32))
    e, v = W.refine(a, rough.astype(np.float64))
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-13)
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-12

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelore.operators import vectors as V


def _vectors(spark, n, dim=8, seed=1, id_type="long"):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    ids = [i * 3 for i in range(n)] if id_type == "long" else [f"v{i:03}" for i in range(n)]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, data)]
    return ids, data.astype(np.float64), spark.createDataFrame(rows, f"vec_id {id_type}, embedding array<float>")


@pytest.mark.parametrize("block_rows, id_type", [(1000, "long"), (10, "long"), (7, "string")])
@pytest.mark.parametrize("min_value", [float("-inf"), 2.5])
def test_pairwise_inner(spark, block_rows, id_type, min_value):
    ids, data, df = _vectors(spark, 60, id_type=id_type)
    full = data @ data.T
    want = {
        (ids[i], ids[j]): full[i, j]
        for i in range(60)
        for j in range(i + 1, 60)
        if full[i, j] >= min_value
    }
    got = {(r["i"], r["j"]): r["value"] for r in V.pairwise_inner(df, min_value, block_rows=block_rows).collect()}
    assert got == pytest.approx(want)


def test_clustered_vectors_meet_in_few_blocks(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 4
    data = np.vstack([c + rng.normal(scale=0.05, size=(25, 8)) for c in centres]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    full = data @ data.T
    want = {(i, j): full[i, j] for i in range(200) for j in range(i + 1, 200) if full[i, j] >= 14}
    got = {(r["i"], r["j"]): r["value"] for r in V.pairwise_inner(df, 14, block_rows=10).collect()}
    assert got == pytest.approx(want) and len(want) == 8 * 25 * 24 / 2
    pivots = data[::5]
    own = np.linalg.norm(data[:, None] - pivots, axis=2)
    cells = own.argmin(axis=1)
    radius = {int(c): float(own[cells == c, c].max()) for c in set(cells)}
    assert len(V.meeting_cells(pivots, radius, 14)) < 0.2 * len(radius) ** 2


def test_pairwise_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.pairwise_inner(df, 0.0).count() == 0


def test_embed_in_batches(spark):
    texts = [f"word{i % 5} other word{i % 3}" for i in range(250)] + ["", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string").repartition(3)

    def sizes():
        def encode(batch):
            assert 0 < len(batch) <= 100
            return np.array([[len(t), len(batch)] for t in batch])

        return encode

    got = {r["id"]: r["embedding"] for r in V.embed(df, encoder=sizes).collect()}
    assert len(got) == len(texts) and all(got[str(i)][0] == len(t or "") for i, t in enumerate(texts))
    default = {r["id"]: np.array(r["embedding"]) for r in V.embed(df).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1.0 if texts[int(i)] else 0.0, abs=1e-6) for i, v in default.items())
    assert np.array_equal(default["0"], default["15"]) and not np.array_equal(default["0"], default["1"])


def test_project_2d(spark):
    ids, data, df = _vectors(spark, 80)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(unit.T))
    want = []
    for k in (-1, -2):
        axis = vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
        want.append(unit @ axis)
    got = {r["vec_id"]: (r["x_1"], r["x_2"]) for r in V.project_2d(df, "vec_id").collect()}
    assert np.allclose([got[i] for i in ids], np.array(want).T, atol=1e-5)


def test_labels_by_key(spark):
    comments = spark.createDataFrame(
        [("c1", "u1", "x"), ("c2", "u2", "y"), ("c3", "gone", "z")], "id string, user_id string, content string"
    )
    users = spark.createDataFrame([("u2", None), ("u1", "INFP")], "id string, mbti_type string")
    vectors = spark.createDataFrame([("c2", [1.0]), ("c1", [2.0]), ("c3", [3.0])], "id string, embedding array<float>")
    labelled = {r["id"]: (r["embedding"], r["label"]) for r in V.label_vectors(vectors, comments, users).collect()}
    assert labelled == {"c1": ([2.0], "INFP"), "c2": ([1.0], None)}
    points = spark.createDataFrame([("c1", 0.1, 0.2), ("c2", 0.3, 0.4)], "id string, x_1 double, x_2 double")
    table = sorted(tuple(r) for r in V.plot_table(points, comments, users).collect())
    assert table == [("c1", 0.1, 0.2, "x", "INFP"), ("c2", 0.3, 0.4, "y", "NA")]


def _brute_top(ids, data, k):
    full = data @ data.T
    out = []
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-full[a, b], ids[b]))[:k]
        out += [(ids[a], r + 1, ids[b], full[a, b]) for r, b in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, partners, id_type", [(1000, 8, "long"), (7, 2, "long"), (5, 3, "string")])
def test_top_inner_against_brute_force(spark, block_rows, partners, id_type):
    ids, data, df = _vectors(spark, 45, id_type=id_type)
    got = sorted(tuple(r) for r in V.top_inner(df, 4, block_rows=block_rows, partners=partners).collect())
    want = _brute_top(ids, data, 4)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_top_inner_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0]), (5, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in V.top_inner(df, 2, block_rows=2, partners=1).collect())
    # equal vectors tie and go to the smaller id; a copy of the row's own id is a partner; other lengths never meet
    assert got == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (2, 2, 2, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]
    assert V.top_inner(df.limit(0), 3).count() == 0 and V.top_inner(df.filter("vec_id = 5"), 3).count() == 0


def test_top_inner_sends_a_row_once_per_group(spark, monkeypatch):
    """Blocks are sent per group of query blocks and per group of partners, in single precision if that is what they are."""
    ids, data, df = _vectors(spark, 60)
    single = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    sent = []
    grouped = type(df).groupBy

    def watched(self, *keys):
        if all(isinstance(c, str) for c in keys) and keys == ("q", "g"):
            sent.append((self.selectExpr("sum(size(ids))").first()[0], self.schema["flat"].dataType.simpleString()))
        return grouped(self, *keys)

    monkeypatch.setattr(type(df), "groupBy", watched)
    got = V.top_inner(single, 3, block_rows=5, partners=4, queries=3)
    assert sent == [(60 * (3 + 4), "array<float>")]
    want = _brute_top(ids, data.astype(np.float32).astype(float), 3)
    assert [tuple(r)[:3] for r in sorted(map(tuple, got.collect()))] == [w[:3] for w in want]


def test_pairs_of_blocks_larger_than_a_strip(spark, monkeypatch):
    monkeypatch.setattr(V, "STRIP", 4)
    ids, data, df = _vectors(spark, 70)
    single = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert V._with_cell(single, "vec_id", data[:2]).schema["embedding"].dataType.simpleString() == "array<float>"
    got = {(r.i, r.j): r.value for r in V.pairwise_inner(single, 0.1, block_rows=30).collect()}
    exact = data.astype(np.float32).astype(float)
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])): exact[a] @ exact[b] for a in range(70) for b in range(a) if exact[a] @ exact[b] >= 0.1}
    assert got == pytest.approx(want)

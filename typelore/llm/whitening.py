"""Whitening of embeddings: principal components of a distributed covariance, refined to double precision.

Vectors are put on an integer grid first, so that distinct vectors, their count and their sums are exact. Spark
computes the sums and the centred cross products; only the ``d x d`` matrix reaches the driver, whose size follows the
dimension and never the number of rows. There the eigenvectors are solved in float32 and then corrected by the
iterations of Ogita and Aishima (matrix products in extended precision); eigenvalues too close to be told apart by one
correction are solved again together, within the space of their cluster. The projection of every row is a Spark
expression over literal arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.session import cut_lineage

#: Entries are put on a grid of this many steps per unit: x = floor(SCALE * c).
SCALE = 256
#: Corrections at most; they stop earlier once a step moves no entry by more than TOLERANCE.
ROUNDS, TOLERANCE = 12, 1e-15
#: Eigenvalues closer than this share of the largest are always solved together as a cluster: a first-order step
#: cannot separate them in extended precision, the shifted small problem can.
CLUSTER = 1e-8


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, sums, mean, covariance and the refined eigen pairs (falling)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def grid(vector: Column, scale: int = SCALE) -> Column:
    """Each entry c as long floor(scale * c); the vector must be clean (see ``clean``)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def clean(vector: Column) -> Column:
    """True where the vector is not null and holds neither nulls nor NaN nor infinities."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _gram(mean: list[float]):
    centre = np.asarray(mean, dtype=np.float64)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            if len(batch):
                y = np.stack(batch["x"].to_numpy()).astype(np.float64) - centre
                total += y.T @ y
        yield pd.DataFrame({"i": np.arange(len(centre)), "row": list(total)})

    return partial


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigen pairs of the symmetric ``a`` from approximate eigenvectors ``x`` (columns), by Ogita-Aishima steps.

    Each step forms R = I - X'X and S = X'AX in extended precision, takes eigenvalues s_ii / (1 - r_ii) and corrects X by
    X E, where E_ij = (s_ij + l_j r_ij) / (l_j - l_i) for eigenvalues further apart than delta, and r_ij / 2 otherwise.
    Those that are closer form clusters; after the step each cluster is solved again in its own span (the small pencil
    X_J' A X_J, X_J' X_J), which separates them and makes them orthonormal. Returns eigenvalues and vectors, falling, each vector's largest entry positive.
    """
    a = np.asarray(a, dtype=np.longdouble)
    x = np.asarray(x, dtype=np.longdouble)
    d = len(a)
    if d == 0:
        return np.zeros(0), np.zeros((0, 0))
    norm_a = float(np.linalg.norm(a.astype(np.float64), 2))
    for _ in range(rounds):
        r = np.eye(d, dtype=np.longdouble) - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        delta = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm_a * np.linalg.norm(r.astype(np.float64), 2))
        delta = max(delta, CLUSTER * norm_a)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        if float(np.abs(e).max()) < TOLERANCE:
            break
        for cluster in _clusters(values, delta):
            if len(cluster) > 1:
                part = x[:, cluster]
                gram = (part.T @ part).astype(np.float64)
                inverse = np.linalg.inv(np.linalg.cholesky((gram + gram.T) / 2)).astype(np.longdouble)
                part = part @ inverse.T
                # shifted by the cluster's mean eigenvalue, the small matrix keeps the gaps in double precision
                small = part.T @ a @ part
                shift = np.trace(small) / len(cluster)
                small = (small - shift * np.eye(len(cluster), dtype=np.longdouble)).astype(np.float64)
                _, turn = np.linalg.eigh((small + small.T) / 2)
                x[:, cluster] = part @ turn.astype(np.longdouble)
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values.astype(np.float64), kind="stable")
    values, x = values[order], x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    signs = np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return values.astype(np.float64), (x * signs).astype(np.float64)


def _clusters(values: np.ndarray, delta: float) -> list[list[int]]:
    order = np.argsort(values.astype(np.float64))
    found, current = [], [int(order[0])]
    for before, here in zip(order, order[1:]):
        if abs(float(values[here] - values[before])) <= delta:
            current.append(int(here))
        else:
            found.append(current)
            current = [int(here)]
    return found + [current]


def fit(x: DataFrame) -> Fit:
    """Eigen pairs of the covariance of the distinct grid vectors in column ``x`` (all of one length).

    The sums are exact (decimal); the cross products are summed per partition over vectors centred by the mean first,
    then over partitions by element. The matrix is d x d on the driver.
    """
    fitted = cut_lineage(x.select("x").distinct(), "fit_list")
    first = fitted.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    n = fitted.count()
    sums_by_j = {r.j: int(r.s) for r in first.collect()}
    d = len(sums_by_j)
    sums = [sums_by_j[j] for j in range(d)]
    if n == 0 or d == 0:
        return Fit(n, sums, np.zeros(d), np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))
    mean = [s / n for s in sums]
    parts = fitted.mapInPandas(_gram(mean), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    covariance = np.zeros((d, d))
    for r in cells.collect():
        covariance[r.i, r.j] = r.v / n
    covariance = (covariance + covariance.T) / 2
    _, rough = np.linalg.eigh(covariance.astype(np.float32))
    values, vectors = refine(covariance, rough.astype(np.float64))
    return Fit(n, sums, np.asarray(mean), covariance, values, vectors)


def _dot(x: Column, mean: list[float], weights: list[float]) -> Column:
    m, w = F.array(*[F.lit(v) for v in mean]), F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(
        F.sequence(F.lit(1), F.size(x)),
        F.lit(0.0),
        lambda acc, j: acc + (F.element_at(x, j).cast("double") - F.element_at(m, j)) * F.element_at(w, j),
    )


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per clean row and component.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; so are rows of another length than
    the most frequent one among the clean rows (ties: the longer), since they have no place in one covariance. Each entry
    becomes x = floor(256 c). The fit list holds each distinct x once: ``n`` vectors with sums S. ``deviation`` is
    sum_j (n x_j - S_j)^2, exact (it raises if beyond a long). ``whitened`` is (x - S/n) projected on the component,
    divided by the square root of its eigenvalue; ``explained`` is the eigenvalue over the trace; ``identity_error`` the
    largest entry of |cov(whitened) - I| over the fit list. Components are numbered from 1 by falling eigenvalue, at most
    ``components`` and the dimension; those with a zero eigenvalue are left out. Repeated rows each get their rows, a null
    key stays null, other columns are not carried (so no name can clash), an empty table gives no rows.
    """
    ok = vectors.select(F.col(key).alias("_key"), F.col(column).alias("_v")).filter(clean(F.col("_v")))
    lengths = ok.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return _empty(vectors, key)
    d = lengths[0].d
    grid_rows = cut_lineage(ok.filter(F.size("_v") == d).select("_key", grid(F.col("_v")).alias("x")), "grid")
    found = fit(grid_rows)
    keep = [k for k in range(min(components, d)) if found.values[k] > 0]
    if not keep:
        return _empty(vectors, key)
    trace = float(np.trace(found.covariance))
    weights = [found.vectors[:, k] / np.sqrt(found.values[k]) for k in keep]
    projections = [_dot(F.col("x"), found.mean.tolist(), w) for w in weights]
    identity = _identity_error(grid_rows.select("x").distinct(), projections, found.n)
    sums = F.array(*[F.lit(s).cast("decimal(38,0)") for s in found.sums])
    deviation = F.aggregate(
        F.sequence(F.lit(1), F.size("x")),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, j: (
            acc + F.pow(F.element_at("x", j).cast("decimal(38,0)") * F.lit(found.n) - F.element_at(sums, j), 2).cast("decimal(38,0)")
        ).cast("decimal(38,0)"),
    )
    each = F.array(
        *[
            F.struct(F.lit(i + 1).alias("component"), p.alias("whitened"), F.lit(float(found.values[k] / trace)).alias("explained"))
            for i, (k, p) in enumerate(zip(keep, projections))
        ]
    )
    out = grid_rows.select("_key", deviation.cast("long").alias("deviation"), F.inline(each))
    return out.select(
        F.col("_key").alias(key),
        "component",
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(identity).alias("identity_error"),
    )


def _identity_error(fitted: DataFrame, projections: list[Column], n: int) -> float:
    k = len(projections)
    w = fitted.select(*[p.alias(f"w{i}") for i, p in enumerate(projections)])
    sums = w.agg(*[F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(sums[f"c{i}_{j}"] / n - (i == j)) for i in range(k) for j in range(i, k))


def _empty(vectors: DataFrame, key: str) -> DataFrame:
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.sparkSession.createDataFrame([], schema)

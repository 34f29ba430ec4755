"""Quality scores by positive-unlabelled learning.

The risk is the non-negative unbiased estimate: trusted positives and unlabelled documents, mixed by the class prior;
the part that stands for negatives is not allowed below zero. The prior is estimated first: among the thresholds of a
plain positive-against-unlabelled classifier, the least share of unlabelled to positive documents above the threshold,
with a margin for sampling error, since only positives are left where that share is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled and most unlabelled documents that a model is fitted on; scores are computed for all.
SAMPLE = 20_000

_KINDS = np.zeros(256, np.uint8)
for _kind, _characters in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n",
     b"#*$%&<>", b"|", b"!", b".,;:?'\"()-", bytes(range(128, 256))), 1
):
    _KINDS[list(_characters)] = _kind
_N_KINDS = 11


def features(texts: list[bytes]) -> np.ndarray:
    """A row of measurements per whole text, then their squares and products."""
    rows = np.zeros((len(texts), 18))
    for row, text in zip(rows, texts, strict=True):
        kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=_N_KINDS)
        tokens = text.split()
        n = max(len(tokens), 1)
        lines = [line for line in text.split(b"\n") if line.strip()]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        row[:_N_KINDS] = kinds / max(len(text), 1)
        row[3] = np.sqrt(row[3])
        row[11] = np.log1p(len(tokens))
        row[12] = lengths.mean() if len(tokens) else 0
        row[13] = (lengths <= 3).mean() if len(tokens) else 0
        row[14] = len(set(tokens)) / n
        row[15] = len(set(zip(tokens, tokens[1:], strict=False))) / n
        row[16] = sum(map(bytes.__eq__, tokens, tokens[1:])) / n
        row[17] = 1 - len(set(lines)) / max(len(lines), 1)
    return rows


def _expanded(x: np.ndarray) -> np.ndarray:
    upper = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, (x[:, upper[0]] * x[:, upper[1]])])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _expanded(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, n: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam on a full batch."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both that no fit has seen."""
    cuts = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 0.95, 96))
    share_p = np.array([(positive >= c).mean() for c in cuts])
    share_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(200) / (2 * max(len(positive), 1))) + np.sqrt(np.log(200) / (2 * max(len(unlabelled), 1)))
    enough = share_p > 0.05
    bound = np.where(enough, (share_u + margin) / np.maximum(share_p, 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98)) if np.isfinite(bound[best]) else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-3) -> Model:
    """Non-negative risk on features of trusted positives and of unlabelled documents; without either all score 0.5."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(_expanded(np.zeros((1, width))).shape[1]), 0.5)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (_expanded(np.clip((x - mean) / scale, -6, 6)) for x in (positive, unlabelled))

    def plain(w: np.ndarray) -> np.ndarray:
        return u[::2].T @ _sigmoid(u[::2] @ w) / len(u[::2]) - p[::2].T @ _sigmoid(-(p[::2] @ w)) / len(p[::2]) + l2 * w

    rough = _descend(plain, p.shape[1], 200)
    held_p, held_u = (p[1::2], u[1::2]) if min(len(p), len(u)) > 1 else (p, u)
    prior = estimate_prior(held_p @ rough, held_u @ rough)

    def risk(w: np.ndarray) -> np.ndarray:
        z_p, z_u = p @ w, u @ w
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_negative = u.T @ _sigmoid(z_u) / len(u) - prior * (p.T @ _sigmoid(z_p)) / len(p)
        if negative < 0:
            return -g_negative
        return g_negative - prior * (p.T @ _sigmoid(-z_p)) / len(p) + l2 * w

    return Model(mean, scale, _descend(risk, p.shape[1]), prior)


# ---- on tables ---------------------------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of ids whose labels are never read."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def drawn(doc_id: str, share: float, seed: int) -> Column:
    """A fixed draw of about ``share`` of the ids."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` positives and as many unlabelled documents, all outside the held-out third.

    The sample is drawn by hashed id; its features, some twenty numbers each, are what reaches the driver.
    """
    trusted = labels.filter("quality = 1").filter(~held_out()).select("doc_id").distinct()
    share = sample / max(trusted.count(), 1)
    # bounded by the parameter, so it may be broadcast
    chosen = F.broadcast(trusted.filter(drawn("doc_id", share, 1)).withColumn("_positive", F.lit(1)))
    share_u = sample / max(docs.count(), 1)
    source = docs.select("doc_id", F.col(text).cast("binary").alias("_t")).filter(~held_out())
    marked = source.join(chosen, "doc_id", "left").withColumn("_unlabelled", drawn("doc_id", share_u, 2))
    used = marked.filter("_positive = 1 OR _unlabelled").select(
        (F.coalesce("_positive", F.lit(0)) == 1).alias("positive"), F.col("_unlabelled").alias("unlabelled"), "_t"
    )

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            x = features([t or b"" for t in batch.column("_t").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), batch.column("unlabelled"), pa.array(list(x), pa.list_(pa.float64()))],
                ["positive", "unlabelled", "x"],
            )

    got = used.mapInArrow(run, "positive boolean, unlabelled boolean, x array<double>").toPandas()
    x = np.stack(got["x"]) if len(got) else np.zeros((0, 18))
    order = np.lexsort(x.T)  # the fit does not depend on the order in which rows arrive
    x, got = x[order], got.iloc[order]
    return fit(x[got["positive"].to_numpy(bool)], x[got["unlabelled"].to_numpy(bool)])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into`` (double, 0 to 1) for whole texts; null counts as empty. Rows stay where they are."""
    if {into, "_t"} & set(df.columns):
        raise ValueError(f"column already exists: {into}")

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(features([t or b"" for t in texts])))

    return df.withColumn(into, scored(F.col(text).cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) to every row.

    Labels come only from outside the held-out third; language, source and id are no inputs. A row without id is
    scored like any other, repeated rows get the same score, an empty table gives an empty result.
    """
    scored = score(docs.withColumn("held_out", held_out()), train(docs, labels, text), text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

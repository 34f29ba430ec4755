"""Toxicity scores by weak supervision.

Voters are lexicon entries (words, and word beginnings of four and five bytes) and patterns over them. A generative label
model estimates how often each voter fires on toxic and on clean documents, and how voters depend on each other within a
class; a voter that repeats what others say counts for less. A linear classifier over a wider vocabulary is then trained
on the posterior labels of unlabelled documents and scores every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.llm.quality_classifier import _descend, _sigmoid, drawn, held_out

#: Most labelled documents per class, and most unlabelled ones, that are read for fitting; all documents are scored.
SAMPLE = 8_000
#: Lexicon entries that vote, and entries that the classifier sees.
VOTERS, ENTRIES = 400, 2_000
#: Nats by which the labels of an entry's documents must speak against chance.
EVIDENCE = 12.0

#: Lower case for A-Z, and white space for the rest of ASCII that is no letter or digit.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def entries(text: bytes) -> set[bytes]:
    """Words and word beginnings of a whole text; a beginning is marked by its length in front."""
    tokens = set(text.translate(_PLAIN).split())
    found = {b"4" + w[:4] for w in tokens if len(w) > 4}
    found |= {b"5" + w[:5] for w in tokens if len(w) > 5}
    found |= {b"=" + w for w in tokens}
    return found


@dataclass(frozen=True)
class LabelModel:
    """Rates at which voters fire on toxic and clean documents, what each counts for, and the share of toxic ones."""

    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Share of toxic ones among documents with these votes; a voter that does not fire abstains."""
        fired = np.log(self.toxic / self.clean) * self.weight
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ fired)


def _dependence(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over the other voters of the squared correlation within a class, averaged over the classes."""
    total = np.zeros(votes.shape[1])
    for share in (p, 1 - p):
        mass = share.sum() + 1e-9
        centred = (votes - share @ votes / mass) * np.sqrt(share / mass)[:, None]
        cov = centred.T @ centred
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        total += ((cov / scale[:, None] / scale) ** 2).sum(axis=1) * (0.5 if mass > 1 else 0)
    return np.maximum(total, 1)


def fit_label_model(
    votes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float, strength: float = 50, rounds: int = 15
) -> LabelModel:
    """Expectation maximisation from the rates seen on labelled documents, which also act as a prior of ``strength`` rows."""
    model = LabelModel(toxic, clean, np.ones(len(toxic)), prior)
    for _ in range(rounds if len(votes) else 0):
        p = model.posterior(votes)
        weight = 1 / _dependence(votes, p)
        weight[toxic < clean] = 1  # a vote for clean stands alone
        new = [
            np.clip((strength * seen + share @ votes) / (strength + share.sum()), 1e-5, 1 - 1e-5)
            for seen, share in ((toxic, p), (clean, 1 - p))
        ]
        # a voter stays on its side
        bound = np.where(toxic > clean, np.maximum(new[0], new[1] * 1.01), np.minimum(new[0], new[1] / 1.01))
        model = LabelModel(np.minimum(bound, 1 - 1e-5), new[1], weight, prior)
    return model


def pattern_votes(votes: np.ndarray, kinds: Sequence[str]) -> np.ndarray:
    """Voters over voters: several words, several beginnings, and, as the one vote for clean, no entry at all."""
    kind = np.array(list(kinds), dtype="U1")
    words, beginnings = votes[:, kind == "="], votes[:, kind != "="]
    more = [words.sum(axis=1) >= 2, beginnings.sum(axis=1) >= 3]
    more.append(~votes.any(axis=1))
    return np.column_stack([votes, *more]).astype(np.float64)


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        known = self.weights.keys()
        z = [self.bias + sum(map(self.weights.__getitem__, entries(t) & known)) for t in texts]
        return _sigmoid(np.array(z, dtype=np.float64))


# ---- on tables ---------------------------------------------------------------------------------------------------------


def _associated(marked: DataFrame) -> DataFrame:
    """(entry, toxic, clean): numbers of labelled documents with an entry, summed up per batch before they are shuffled."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("_t").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[1 - toxic].update(entries(text or b""))
            names = list(counts[0] | counts[1])
            columns = [pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])

    counted = marked.select("_t", "toxic").mapInArrow(run, "entry binary, toxic long, clean long")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(toxic: Column, clean: Column, share: float) -> Column:
    """Documents times the divergence of their toxic share from the share among all labelled ones."""
    both = toxic + clean
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` labelled documents of each class and as many unlabelled ones outside the held-out third."""
    labelled = labels.filter("toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return Model({}, -4.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / max(sizes.get(0, 0), 1)))
    spot = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(labelled.filter(spot < share))  # bounded by the parameter
    source = docs.select("doc_id", F.col(text).cast("binary").alias("_t")).filter(~held_out())
    n = {k: max(r, 1) for k, r in ((0, min(sample, sizes.get(0, 0))), (1, min(sample, sizes[1])))}
    rate = lambda c, k: (F.col(c) + 0.5) / (n[k] + 1.0)
    strength = F.log(rate("toxic", 1) / rate("clean", 0)) * F.sqrt("toxic")
    ranked = (
        _associated(source.join(chosen, "doc_id"))
        .filter(rate("toxic", 1) >= 8 * rate("clean", 0))
        .filter(_evidence(F.col("toxic"), F.col("clean"), n[1] / (n[0] + n[1])) >= EVIDENCE)
        .orderBy(strength.desc(), "entry")
        .limit(ENTRIES)
    )
    lexicon = ranked.select("entry", "toxic", "clean").collect()  # bounded by ENTRIES
    if not lexicon:
        return Model({}, -4.0)
    names = [bytes(r.entry) for r in lexicon]
    index = {name: i for i, name in enumerate(names)}

    def hits(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.keys()
        for batch in arrow:
            found = [sorted(index[e] for e in entries(t or b"") & known) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["hits"])

    share_u = sample / max(docs.count(), 1)
    unlabelled = source.filter(drawn("doc_id", share_u, 2)).select("_t").mapInArrow(hits, "hits array<int>").toPandas()
    rows = sorted(tuple(h) for h in unlabelled["hits"])
    x = np.zeros((len(rows), len(names)))
    for row, h in zip(x, rows, strict=True):
        row[list(h)] = 1
    voters = min(VOTERS, len(names))
    votes = pattern_votes(x[:, :voters], [chr(name[0]) for name in names[:voters]])
    seen = {k: np.array([(r[k] + 0.5) / (n[1 - j] + 1.0) for r in lexicon[:voters]]) for j, k in enumerate(("toxic", "clean"))}
    # for the patterns the labelled rates are not at hand: they start from the voters they stand for
    some = lambda rates: float(np.clip(rates.sum() / 2, 1e-4, 0.5))
    none = lambda rates: float(np.clip(np.prod(1 - rates), 0.1, 0.9))
    toxic, clean = (
        np.clip(np.concatenate([seen[k], [some(seen[k])] * 2, [none(seen[k])]]), 1e-5, 1 - 1e-5) for k in ("toxic", "clean")
    )
    clean[:-1] = np.minimum(clean[:-1], toxic[:-1] / 1.01)
    toxic[-1] = min(toxic[-1], clean[-1] / 1.01)
    prior = float(np.clip(sizes[1] / sum(sizes.values()), 0.001, 0.5))
    model = fit_label_model(votes, toxic, clean, prior)
    return _linear(x, model.posterior(votes), names)


def _linear(x: np.ndarray, target: np.ndarray, names: list[bytes], l2: float = 3e-4) -> Model:
    full = np.hstack([x, np.ones((len(x), 1))])
    if not len(full):
        return Model({}, -4.0)
    penalty = np.concatenate([np.full(len(names), l2), [0]])
    w = _descend(lambda w: full.T @ (_sigmoid(full @ w) - target) / len(full) + penalty * w, full.shape[1], 300, 0.1)
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds ``held_out``, ``score`` (double, 0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row.

    Labels come only from outside the held-out third; language, source and id are no inputs. Whole texts are scored where
    they are, null as an empty one. Without toxic labels every score is low. Repeated rows get the same score, rows
    without id are scored too, an empty table gives an empty result.
    """
    clash = {"held_out", "score", "predicted"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
    model = train(docs, labels, text)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score([t or b"" for t in texts]))

    with_score = docs.withColumn("held_out", held_out()).withColumn("score", scored(F.col(text).cast("binary")))
    return with_score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

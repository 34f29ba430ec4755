"""Approximate nearest neighbours with an inverted multi-index.

The two halves of the vectors are quantised apart, so ``k`` centroids each make ``k * k`` cells. A query walks through
the cells in order of the sum of its two centroid distances, with a heap over pairs of ranks, until the cells hold as
many vectors as its budget allows; the vectors in them are ranked by their true distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions.top_n import first_n_per_group
from typelore.session import cut_lineage

#: Vectors that the centroids are fitted on at most, and queries among them that set the budget.
SAMPLE, TRIALS = 20_000, 200
#: Vectors and queries that meet in one task at a time.
BLOCK = 2_000


@dataclass(frozen=True)
class Index:
    """Centroids of the two halves, and the share of all vectors that a query visits."""

    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(vectors[:, :half], self.first), _squared(vectors[:, half:], self.second)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.distances(vectors)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
    """Cells in order of summed distance until their sizes reach the budget; empty cells are passed over."""
    order_1, order_2 = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    d_1, d_2, i_1, i_2 = one[order_1].tolist(), two[order_2].tolist(), order_1.tolist(), order_2.tolist()
    heap, done, cells, held = [(d_1[0] + d_2[0], 0, 0)], [0] * len(d_1), [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = i_1[i] * len(d_2) + i_2[j]
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        # a pair enters once both its neighbours with smaller ranks have been taken
        if i + 1 < len(d_1) and (j == 0 or done[i + 1] == j) and done[i + 1] <= j:
            heapq.heappush(heap, (d_1[i + 1] + d_2[j], i + 1, j))
        if j + 1 < len(d_2) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (d_1[i] + d_2[j + 1], i, j + 1))
    return cells


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _squared(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            members = x[own == c]
            if len(members):
                centres[c] = members.mean(axis=0)
    return centres


def fit(sample: np.ndarray, k: int = 64, neighbours: int = 10, recall: float = 0.95) -> Index:
    """Centroids from a sample, and the smallest share visited that finds enough of the true neighbours within it."""
    half = sample.shape[1] // 2
    k = max(1, min(k, len(sample) // 8))
    index = Index(_centroids(sample[:, :half], k), _centroids(sample[:, half:], k), 1.0)
    trials = sample[:: max(1, len(sample) // TRIALS)]
    cell = index.cell(sample)
    sizes = np.bincount(cell, minlength=index.cells)
    one, two = index.distances(trials)
    # position of each true neighbour in the order of visits, as a share of the sample
    needed = []
    for q, vector in enumerate(trials):
        true = np.argsort(((sample - vector) ** 2).sum(axis=1), kind="stable")[1 : neighbours + 1]
        seen = np.cumsum(sizes[(order := np.argsort((one[q][:, None] + two[q]).ravel(), kind="stable"))])
        place = np.empty(index.cells, np.int64)
        place[order] = seen
        needed.extend(place[cell[true]] / len(sample))
    share = float(np.quantile(needed, recall)) if needed else 1.0
    return Index(index.first, index.second, min(1.0, share))


# ---- on tables ---------------------------------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """False for vectors that are null, zero, or hold null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _stack(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def search(
    df: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = 10,
    index: Index | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest vectors by Euclidean distance, for the rows that are queries.

    Every usable row is indexed and may be found; a query does not find its own row. Ties go to the smaller id. Without
    an ``index`` one is fitted on ``SAMPLE`` rows drawn by hashed id. Vectors of another length than most of the sample
    are an error. Rows that repeat an id are candidates of their own, but are never found by a query of the same id. An
    empty table, or one without usable vectors, gives an empty result; all other columns are ignored.

    Equal vectors are one entry with their ``neighbours + 1`` smallest ids, more of which cannot be among the nearest. The
    sizes of cells are one number per cell. Blocks of vectors meet blocks of queries that visit some of their cells, so neither
    a large cell nor one that all queries visit gathers in one task, and each query leaves a block with its nearest only.
    """
    spark = df.sparkSession
    rows = df.filter(usable(vector)).filter(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked")
    )
    total = rows.count()
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if index is None:
        drawn = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / total) * (1 << 30))
        got = rows.filter(drawn).select("id", "v").toPandas().sort_values("id")
        index = fit(np.stack(got["v"]) if len(got) else np.stack(rows.select("v").limit(1).toPandas()["v"]), neighbours=neighbours)

    kept = first_n_per_group(rows.select("id", "v"), ["v"], [F.col("id")], neighbours + 1, salts=16)
    unique = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    placed = cut_lineage(_placed(unique, index), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    held = np.zeros(index.cells, np.int64)
    for cell, size in sizes.collect():  # one number per cell, and cells are fixed by the index
        held[cell] = size
    budget = int(np.ceil(index.share * held.sum()))

    # neighbouring cells make shards of about BLOCK vectors; a larger cell is a shard of its own, cut into parts
    shard, full = np.zeros(index.cells, np.int64), 0
    for cell, size in enumerate(held.tolist()):
        if cell and full + size > BLOCK:
            shard[cell], full = shard[cell - 1] + 1, 0
        elif cell:
            shard[cell] = shard[cell - 1]
        full += size
    in_shard = np.bincount(shard, weights=held)

    def visits(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if not batch.num_rows:
                continue
            one, two = index.distances(_stack(batch.column("v")))
            for i in range(batch.num_rows):
                cells = np.sort(np.array(walk(one[i], two[i], held, budget), np.int64))
                names, starts = np.unique(shard[cells], return_index=True)
                repeated = batch.slice(i, 1).take(pa.array(np.zeros(len(names), np.int64)))
                listed = pa.array(np.split(cells, starts[1:]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(names), listed], ["query_id", "v", "shard", "cells"])

    queries = rows.filter("asked").select(F.col("id").alias("query_id"), "v")
    visited = cut_lineage(
        queries.mapInArrow(visits, "query_id long, v array<double>, shard long, cells array<long>"), "visits"
    )
    asked = visited.groupBy("shard").agg(F.count(F.lit(1)).alias("asked")).collect()  # at most a row per cell
    shape = [(r.shard, max(1, -(-int(in_shard[r.shard]) // BLOCK)), -(-r.asked // BLOCK)) for r in asked]
    shape = F.broadcast(spark.createDataFrame(shape, "shard long, parts int, groups int"))
    of_cell = F.broadcast(spark.createDataFrame(list(enumerate(shard.tolist())), "cell long, shard long"))
    # vectors and visits are dealt over the pairs of parts of vectors and groups of queries of their shard
    vectors = placed.join(of_cell, "cell").join(shape, "shard").select(
        "shard", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "cell", "v", "ids",
    )
    asking = visited.join(shape, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("group"), "cells", "v", "query_id",
    )

    def rank(left, right):
        import pandas as pd

        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            x, ids, cell = np.stack(left["v"]), left["ids"].to_numpy(), left["cell"].to_numpy()
            near = _squared(np.stack(right["v"]), x)
            for q, row, query, cells in zip(right["query_id"], near, right["v"], right["cells"], strict=True):
                row = np.where(np.isin(cell, cells), row, np.inf)
                # the fast form only narrows down; distances that count are taken from the differences
                kth = np.partition(row, min(neighbours, len(row) - 1))[: neighbours + 1].max()
                most = kth + 1e-6 * (1 + abs(kth)) if np.isfinite(kth) else np.finfo(float).max
                best = []
                for at in np.flatnonzero(row <= most):
                    far = float(np.sqrt(((x[at] - query) ** 2).sum()))
                    best += [(far, int(i)) for i in ids[at] if i != q]
                for far, i in sorted(best)[:neighbours]:
                    out["query_id"].append(q)
                    out["id"].append(i)
                    out["score"].append(far)
        return pd.DataFrame(out).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    keys = ["shard", "part", "group"]
    found = vectors.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(rank, "query_id long, id long, score double")
    best = first_n_per_group(found, ["query_id"], [F.col("score"), F.col("id")], neighbours, rank_col="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _placed(unique: DataFrame, index: Index) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if batch.num_rows:
                cell = pa.array(index.cell(_stack(batch.column("v"))), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), cell], ["v", "ids", "cell"])

    return unique.select("v", "ids").mapInArrow(run, "v array<double>, ids array<long>, cell long")

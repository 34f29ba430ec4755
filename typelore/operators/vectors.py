"""Text vectors, their inner products and their projection to two dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typelore.session import cut_lineage

#: Rows of a block that are multiplied with another block at a time.
STRIP = 500

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashed_words(
    df: DataFrame, text: str = "content", dim: int = 64, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """Words hashed to ``dim`` counters, scaled to length 1: no model file, the same result everywhere.

    Spark splits and hashes the words; their numbers are counted for a whole batch at once.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    hashed = df.select(*keep, slots.alias("_slots"))
    fields = [hashed.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.FloatType()), True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, numbers = batch.num_rows, batch.column(batch.num_columns - 1)
            row = np.repeat(np.arange(n), numbers.value_lengths().to_numpy())
            counts = np.bincount(row * dim + numbers.flatten().to_numpy(), minlength=n * dim).reshape(n, dim)
            lengths = np.linalg.norm(counts, axis=1, keepdims=True)
            flat = (counts / np.where(lengths > 0, lengths, 1.0)).astype(np.float32).ravel()
            vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*keep, "embedding"])

    return hashed.mapInArrow(count, schema)


def embed(
    df: DataFrame,
    text: str = "content",
    encoder: Callable[[], Encoder] | None = None,
    batch_size: int = 100,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """One float vector per text, with the columns ``keep``.

    ``encoder`` builds the encoder, once per task; it is then called with up to ``batch_size`` texts at a time. Without
    one the words are hashed (``hashed_words``).
    """
    if encoder is None:
        return hashed_words(df, text, keep=keep)
    narrow = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [narrow.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.FloatType()), True)])
    kept = list(keep)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                vectors = np.asarray(model(part["_text"].tolist()), dtype=np.float32)
                yield part[kept].assign(embedding=list(vectors))

    return narrow.mapInPandas(encode, schema)


def _with_cell(vectors: DataFrame, id_col: str, pivots: np.ndarray) -> DataFrame:
    """Vectors with the nearest pivot and the distance to it."""
    rows = vectors.select(F.col(id_col).alias("id"), _narrow(vectors).alias("embedding"))
    schema = T.StructType(
        [
            T.StructField("id", vectors.schema[id_col].dataType),
            T.StructField("embedding", rows.schema["embedding"].dataType),
            T.StructField("cell", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"]).astype(np.float64)
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
                cell = far.argmin(axis=1)
                exact = np.linalg.norm(x - pivots[cell], axis=1)
                yield pd.DataFrame({"id": batch["id"], "embedding": batch["embedding"], "cell": cell.astype("int32"), "distance": exact})

    return rows.mapInPandas(assign, schema)


def meeting_cells(pivots: np.ndarray, radius: dict[int, float], min_value: float) -> list[tuple[int, int]]:
    """Pairs of cells, both ways, that may hold vectors whose product reaches ``min_value``.

    A vector is its pivot plus a rest no longer than the radius, which bounds the product from above.
    """
    norm, product = np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    bound = lambda a, b: product[a, b] + norm[a] * radius[b] + norm[b] * radius[a] + radius[a] * radius[b]
    # a little above the bound, for what rounding may take away
    return [(a, b) for a in radius for b in radius if bound(a, b) * (1 + 1e-9) + 1e-9 >= min_value]


def pairwise_inner(
    vectors: DataFrame, min_value: float, id_col: str = "vec_id", block_rows: int = 8000, n_pivots: int = 64
) -> DataFrame:
    """Inner products ``i, j, value`` of at least ``min_value`` with i < j, computed in double precision.

    Vectors are assigned to the nearest of ``n_pivots`` vectors, at most 1,000, drawn by hashed id. Two cells only meet if
    the bound on their products reaches the threshold, so clustered vectors are compared within and between few cells.
    Cells are cut into blocks of about ``block_rows``, each of which is sent once per block it may meet, so larger blocks
    send less. A task multiplies two blocks at a time as matrices, ``STRIP`` rows of one with all of the other, and hands
    on what it finds strip by strip; it holds two blocks and one strip of products. Minus infinity gives the whole matrix above its diagonal, whose size is quadratic; so is the work where vectors have no
    clusters or the threshold is low, since nothing can be left out then.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("i", id_type), T.StructField("j", id_type), T.StructField("value", T.DoubleType())]
    )
    drawn = vectors.select("embedding").orderBy(F.xxhash64(id_col)).limit(min(n_pivots, 1000)).collect()
    if not drawn:
        return spark.createDataFrame([], schema)
    pivots = np.array([r.embedding for r in drawn], dtype=np.float64)
    placed = cut_lineage(_with_cell(vectors, id_col, pivots), "cells")
    # a row per pivot
    cells = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()
    blocks = {r.cell: -(-r.n // block_rows) for r in cells}
    meeting = meeting_cells(pivots, {r.cell: r.radius for r in cells}, min_value)
    counted = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    allowed = spark.createDataFrame([(a, b, blocks[b]) for a, b in meeting], "cell int, other int, other_blocks int")

    # ids are unique, so their hash spreads evenly
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    packed = placed.join(F.broadcast(counted), "cell").groupBy("cell", block.alias("block")).agg(
        F.collect_list(F.struct("id", "embedding")).alias("rows")
    )
    own = F.struct(F.col("cell").alias("c"), F.col("block").alias("b"))
    partner = F.struct(F.col("other").alias("c"), F.col("other_block").alias("b"))
    sent = (
        packed.select("cell", "block", F.col("rows.id").alias("ids"), F.flatten("rows.embedding").alias("flat"))
        .join(F.broadcast(allowed), "cell")
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        .select(F.least(own, partner).alias("low"), F.greatest(own, partner).alias("high"), "cell", "block", "ids", "flat")
        .select("low.*", F.col("high.c").alias("high_c"), F.col("high.b").alias("high_b"), "cell", "block", "ids", "flat")
    )

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pd.concat(list(parts))
        both = [_matrix(row) for row in pair.sort_values(["cell", "block"]).itertuples(index=False)]
        (all_a, whole), (ids_b, b) = both[0], both[-1]
        for start in range(0, len(all_a), STRIP):
            ids_a, a = all_a[start : start + STRIP], whole[start : start + STRIP]
            values = a @ b.T
            wanted = values >= min_value
            if len(both) == 1:
                wanted &= ids_a[:, None] < ids_b[None, :]
            row, column = np.nonzero(wanted)
            first, second = ids_a[row], ids_b[column]
            yield pd.DataFrame(
                {
                    "i": np.where(first < second, first, second),
                    "j": np.where(first < second, second, first),
                    "value": values[row, column],
                }
            )

    return sent.groupBy("c", "b", "high_c", "high_b").applyInPandas(multiply, schema)


def _matrix(block) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(block.ids)
    return ids, np.asarray(block.flat, dtype=np.float64).reshape(len(ids), -1)


def _best(values: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the values that reach their row's ``least`` and are among its ``k`` largest, all ties included."""
    wanted = values >= least[:, None]
    if values.shape[1] > k and np.count_nonzero(wanted) > 4 * k * len(values):
        largest = np.partition(values, -k, axis=1)[:, -k]
        wanted = values >= np.maximum(least, largest)[:, None]
    return np.nonzero(wanted)


def top_inner(
    vectors: DataFrame, k: int, id_col: str = "vec_id", block_rows: int = 1000, partners: int = 64, queries: int = 8
) -> DataFrame:
    """For every row, the ``k`` other rows with the largest inner product: ``i, rank, j, value`` (rank from 1).

    Ties go to the smaller ``j``, then to the earlier row. A row is never its own partner, but another row with the same
    id is one. Rows with a null vector take no part; vectors of another length than the query's are not compared.

    Rows are numbered once (the numbers are written, so a lost executor recomputes the same blocks) and dealt into
    blocks of about ``block_rows``. A task takes ``queries`` query blocks and ``partners`` partner blocks. For each query
    block it visits the partners best first by an upper bound on their products (centre and radius of each block) and
    holds the best ``k`` per row, whose least value is that row's threshold: only rows whose bound reaches it are
    multiplied, and only products that reach it are ever sorted. Each task puts out at most ``k`` rows per query row;
    one window per row merges them. The work stays quadratic in the number of rows, since exact neighbours may lie
    anywhere. A row is sent once per group of query blocks and once per group of partners; memory per task is bounded
    by ``queries + partners`` blocks and one product of two blocks.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("i", id_type), T.StructField("rank", T.IntegerType()), T.StructField("j", id_type), T.StructField("value", T.DoubleType())]
    )
    valid = vectors.select(F.col(id_col).alias("id"), _narrow(vectors).alias("v")).filter("v IS NOT NULL")
    numbered = cut_lineage(valid.withColumn("row", F.monotonically_increasing_id()), "numbered")
    n = numbered.count()
    if n == 0 or k <= 0:
        return spark.createDataFrame([], schema)
    n_blocks = -(-n // block_rows)
    groups, query_groups = -(-n_blocks // partners), -(-n_blocks // queries)
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block")
    packed = cut_lineage(
        numbered.groupBy(block, F.size("v").alias("dim")).agg(
            F.collect_list("id").alias("ids"), F.collect_list("row").alias("rows"), F.flatten(F.collect_list("v")).alias("flat")
        ),
        "blocks",
    )
    query = packed.select((F.col("block") % query_groups).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "*")
    partner = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("q"), (F.col("block") % groups).alias("g"), F.lit(False).alias("asks"), "*"
    )
    heap_schema = T.StructType(
        [T.StructField("qrow", T.LongType()), T.StructField("i", id_type), T.StructField("j", id_type),
         T.StructField("jrow", T.LongType()), T.StructField("value", T.DoubleType())]
    )

    def best_first(group: pd.DataFrame) -> pd.DataFrame:
        sides = [(o.block, o.dim, np.asarray(o.ids), np.asarray(o.rows), _matrix(o)[1]) for o in group[~group.asks].itertuples(index=False)]
        spheres = []
        for *_, y in sides:
            centre = y.mean(axis=0)
            spheres.append((centre, np.linalg.norm(y - centre, axis=1).max(), np.linalg.norm(y, axis=1).max()))
        found = []
        for q in group[group.asks].itertuples(index=False):
            ids, rows, x = np.asarray(q.ids), np.asarray(q.rows), _matrix(q)[1]
            others = [m for m, o in enumerate(sides) if o[1] == q.dim]
            norms = np.linalg.norm(x, axis=1)
            bounds = {m: x @ spheres[m][0] + norms * spheres[m][1] for m in others}
            least = np.full(len(ids), -np.inf)
            none = np.zeros(0, np.int64)
            at, value, j, j_row = none, np.zeros(0), ids[:0], rows[:0]
            for m in sorted(others, key=lambda m: -bounds[m].max()):
                # a little above the bound, for what rounding may take away
                asking = np.flatnonzero(~(bounds[m] + np.abs(bounds[m]) * 1e-9 + 1e-9 < least))
                if not len(asking):
                    continue
                block, _, o_ids, o_rows, y = sides[m]
                values = (x if len(asking) == len(x) else x[asking]) @ y.T
                if not np.isfinite(norms.max() * spheres[m][2]):
                    values[np.isnan(values)] = -np.inf
                if block == q.block:
                    values[rows[asking][:, None] == o_rows] = -np.inf
                row, column = _best(values, least[asking], k)
                if not len(row):
                    continue
                at, value = np.concatenate([at, asking[row]]), np.concatenate([value, values[row, column]])
                j, j_row = np.concatenate([j, o_ids[column]]), np.concatenate([j_row, o_rows[column]])
                order = np.lexsort((j_row, j, -value, at))
                place = np.arange(len(order)) - np.searchsorted(at[order], at[order], "left")
                order = order[place < k]
                at, value, j, j_row = at[order], value[order], j[order], j_row[order]
                full = np.flatnonzero(place[place < k] == k - 1)
                least[at[full]] = value[full]
            real = np.isfinite(value)
            found.append(pd.DataFrame({"qrow": rows[at[real]], "i": ids[at[real]], "j": j[real], "jrow": j_row[real], "value": value[real]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in heap_schema.fieldNames()})

    heaps = query.unionByName(partner).groupBy("q", "g").applyInPandas(best_first, heap_schema)
    ranked = heaps.withColumn(
        "rank", F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("value"), "j", "jrow"))
    )
    return ranked.filter(F.col("rank") <= k).select("i", "rank", "j", "value")


def _narrow(vectors: DataFrame) -> Column:
    """The vectors as they are if single precision, else as doubles; half the bytes are sent, and nothing is rounded."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    return F.col("embedding") if single else F.col("embedding").cast("array<double>")


def label_vectors(vectors: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """Vectors with the type of the comment's author; rows are matched by comment id, never by position.

    Hand in ``users`` as a written table, so that an author of very many comments can be split.
    """
    authors = comments.select("id", "user_id").join(
        users.select(F.col("id").alias("user_id"), F.col("mbti_type").alias("label")), "user_id"
    )
    return vectors.join(authors.select("id", "label"), "id")


def project_2d(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Two coordinates per vector: principal components of the vectors scaled to length 1.

    The driver only sees the d x d covariance. The sign of a component is not determined, so its largest loading is
    made positive.
    """
    scaled = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(
        vectors.select(id_col, array_to_vector("embedding").alias("_raw"))
    )
    model = PCA(k=2, inputCol="_unit", outputCol="_point").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.argmax(np.abs(column))] >= 0 else -1.0 for column in loadings.T]
    point = vector_to_array("_point")
    return model.transform(scaled).select(
        id_col,
        (point[0] * signs[0]).alias("x_1"),
        (point[1] * signs[1]).alias("x_2"),
    )


def plot_table(points: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """``x_1, x_2, content, label`` per comment, ``NA`` where the author has no type. ``users`` as in ``label_vectors``."""
    labels = users.select(F.col("id").alias("user_id"), F.col("mbti_type").alias("label"))
    return (
        points.join(comments.select("id", "user_id", "content"), "id")
        .join(labels, "user_id")
        .select("id", "x_1", "x_2", "content", F.coalesce("label", F.lit("NA")).alias("label"))
    )

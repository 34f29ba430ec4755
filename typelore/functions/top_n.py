"""Exact first-n rows per group when one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salts: int = 1,
    rank_col: str | None = None,
    spread_by: Sequence[str] = ("id",),
) -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    Since ``n`` is a constant, each map task keeps only its own first ``n`` rows of a group before the shuffle (window
    group limit). With ``salts`` above 1 a group is first cut to ``n`` rows in that many parts, over which the columns
    ``spread_by`` spread its rows, and the survivors are ranked together: a row beyond rank ``n`` of its part cannot be
    within rank ``n`` of the group.
    """
    if salts > 1:
        part = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
        by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_rank", F.row_number().over(by_part))
            .filter(F.col("_rank") <= n)
            .drop("_part", "_rank")
        )
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank_col) if rank_col else kept.drop("_rank")

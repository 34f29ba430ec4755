"""Joins on a key of which one value may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of one key from which on they are worth spreading; fewer are no burden for one task.
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, on: Sequence[str], least: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``least`` rows, at most one for so many rows of the input."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > least).select(*on)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    salts: int,
    spread_by: Sequence[str],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that spreads the frequent keys of ``left`` over ``salts`` partitions.

    ``hot`` lists these keys, each once; without it the keys of ``left`` are counted. Only their rows of ``right`` are
    repeated, once per salt: Spark estimates sizes without what a generator adds, so a ``right`` repeated as a whole
    would be broadcast at many times its estimate. The list is broadcast, as it has one key in ``HOT_ROWS`` rows at
    most. Rows of ``left`` without a key, which match nothing, are spread as well.

    ``right`` should be narrow and unique in ``on``. ``spread_by`` names columns of ``left`` that differ between rows of
    one key. Joins straight from two shuffles do not need this: adaptive execution splits their skewed partitions. It
    does not do so when a side is aggregated on the join key just before; such a side is written first
    (``session.cut_lineage``) or joined in this way.
    """
    if salts <= 1:
        return left.join(right, list(on), how)
    listed = (hot_keys(left, on) if hot is None else hot).dropna(subset=list(on)).select(*on, F.lit(salts).alias("_salts"))
    listed = F.broadcast(listed)
    keyless = reduce(or_, (F.col(c).isNull() for c in on))
    parts = F.coalesce("_salts", F.when(keyless, salts), F.lit(1))
    salted_left = left.join(listed, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    salted_right = right.join(listed, list(on), "left").withColumn("_salt", copies)
    return salted_left.drop("_salts").join(salted_right.drop("_salts"), [*on, "_salt"], how).drop("_salt")

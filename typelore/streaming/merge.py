"""Continuous upsert: what is delivered is appended in merged form, what is read is merged once more.

A target holds ``batches/batch=n``, one merged delta per micro-batch, and ``bases/base=n``, all batches up to ``n`` merged into
one by ``compact_*``. The last complete base and the batches after it are the table: a base counts from the moment its
write has committed, and a batch that is replayed later is already in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typelore.operators import merge


def _arrival(batch: DataFrame, batch_id: int) -> DataFrame:
    """Order over all batches: later batches after earlier ones, then the position within the batch."""
    return batch.withColumn("seq", F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("seq").alias("at")))


def _append_merged(target: str, merged: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites what its first run wrote
        merged(_arrival(batch, batch_id)).write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")

    return write


def _start(updates: DataFrame, target: str, checkpoint: str, merged, available_now: bool) -> StreamingQuery:
    writer = (
        updates.writeStream.foreachBatch(_append_merged(target, merged))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_merge_users(updates: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch, one row per id, below ``target``. The cost of a batch does not grow with the target.

    Run ``compact_users`` from time to time, so that the cost of reading does not grow with the number of batches.
    """
    return _start(
        updates, target, checkpoint, lambda b: merge.merge_user_states(merge.user_state(b)), available_now
    )


def stream_merge_comments(
    updates: DataFrame, target: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    return _start(
        updates, target, checkpoint, lambda b: merge.merge_comment_states(merge.comment_state(b)), available_now
    )


def _complete(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the bases or batches whose write has committed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}/*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _states(spark: SparkSession, target: str, upto: int | None = None) -> tuple[list[DataFrame], int]:
    """The last base and the batches after it, and the number of the last batch among them."""
    bases, batches = _complete(spark, target, "bases"), _complete(spark, target, "batches")
    base = bases[-1] if bases else -1
    later = [b for b in batches if b > base and (upto is None or b <= upto)]
    parts = [spark.read.parquet(f"{target}/bases/base={base}")] if bases else []
    if later:
        folders = [f"{target}/batches/batch={b}" for b in later]
        parts.append(spark.read.option("basePath", f"{target}/batches").parquet(*folders).drop("batch"))
    return parts, max([base, *later])


def _compact(spark: SparkSession, target: str, merged: Callable[..., DataFrame]) -> int:
    parts, last = _states(spark, target)
    if len(parts) > 1 or (parts and not _complete(spark, target, "bases")):
        merged(*parts).write.mode("overwrite").parquet(f"{target}/bases/base={last}")
    return last


def compact_users(spark: SparkSession, target: str) -> int:
    """Merges the last base and all complete batches after it into a new base, and returns the last batch in it.

    Batches that arrive meanwhile stay beside it. Folders that a base covers may be removed once no reader is left.
    """
    return _compact(spark, target, merge.merge_user_states)


def compact_comments(spark: SparkSession, target: str) -> int:
    return _compact(spark, target, merge.merge_comment_states)


def read_merged_users(spark: SparkSession, target: str, keep_state: bool = False) -> DataFrame:
    """The target as if all batches had been merged at once."""
    merged = merge.merge_user_states(*_states(spark, target)[0])
    return merged if keep_state else merged.select(*merge.USER_COLUMNS)


def read_merged_comments(
    spark: SparkSession, target: str, keep_parent: bool = False, keep_state: bool = False
) -> DataFrame:
    merged = merge.merge_comment_states(*_states(spark, target)[0])
    if keep_parent:
        merged = merged.withColumn("parent_comment_id", F.col("last_parent"))
    return merged if keep_state else merged.select(*merge.COMMENT_COLUMNS)

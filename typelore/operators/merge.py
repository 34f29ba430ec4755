"""Upserts as aggregations over everything that was delivered.

Rows carry the order of their arrival in ``seq``, which may be a number or a struct such as (batch, position). Merged
tables keep the arrival of the values they hold, so that merging two merged tables gives the same as merging all rows
at once, in any grouping. Each aggregation reduces the rows of an id on the map side first, so an id delivered very
often costs one row per map task in the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER_STATE = ("id", "name", "flair_text", "first_seq", "flair_seq")
USER_COLUMNS = ("id", "name", "flair_text")

FIRST_WINS = ("user_id", "parent_submission_id", "subreddit", "submission_flair_text")
LAST_WINS = ("parent_comment_id", "title", "content", "created_datetime", "upvotes")
COMMENT_COLUMNS = (
    "id",
    "user_id",
    "parent_submission_id",
    "parent_comment_id",
    "title",
    "content",
    "created_datetime",
    "upvotes",
    "subreddit",
    "submission_flair_text",
)
COMMENT_STATE = (*COMMENT_COLUMNS, "first_seq", "last_seq", "last_parent", "parent_seq")


def user_state(updates: DataFrame) -> DataFrame:
    """Delivered user rows (``seq``) in the form that ``merge_user_states`` takes."""
    return updates.select(
        "id", "name", "flair_text", F.col("seq").alias("first_seq"), F.col("seq").alias("flair_seq")
    )


def merge_user_states(*states: DataFrame) -> DataFrame:
    """One row per id: the first name; the first non-empty flair or, if there is none, the last one seen."""
    is_set = F.col("flair_text") != ""
    flair = F.struct("flair_text", "flair_seq")
    merged = (
        reduce(DataFrame.unionByName, states)
        .groupBy("id")
        .agg(
            F.min_by(F.struct("name", "first_seq"), "first_seq").alias("first"),
            F.min_by(flair, F.when(is_set, F.col("flair_seq"))).alias("set"),
            F.max_by(flair, "flair_seq").alias("last"),
        )
    )
    return merged.select("id", "first.*", F.coalesce("set", "last").alias("flair")).select(
        "id", "name", "flair.flair_text", "first_seq", "flair.flair_seq"
    )


def merge_users(current: DataFrame | None, updates: DataFrame, keep_state: bool = False) -> DataFrame:
    """Upsert of ``updates`` into ``current`` (a former result with ``keep_state``, or None)."""
    states = [user_state(updates)] if current is None else [current, user_state(updates)]
    merged = merge_user_states(*states)
    return merged if keep_state else merged.select(*USER_COLUMNS)


def comment_state(updates: DataFrame) -> DataFrame:
    """Delivered comment rows (``seq``) in the form that ``merge_comment_states`` takes."""
    has_parent = F.col("parent_comment_id").isNotNull()
    return updates.select(
        *COMMENT_COLUMNS,
        F.col("seq").alias("first_seq"),
        F.col("seq").alias("last_seq"),
        F.col("parent_comment_id").alias("last_parent"),
        F.when(has_parent, F.col("seq")).alias("parent_seq"),
    )


def merge_comment_states(*states: DataFrame) -> DataFrame:
    """One row per id: author, root, forum and flair as first seen, everything else as last seen."""
    merged = (
        reduce(DataFrame.unionByName, states)
        .groupBy("id")
        .agg(
            F.min_by(F.struct(*FIRST_WINS, "first_seq"), "first_seq").alias("first"),
            F.max_by(F.struct(*LAST_WINS, "last_seq"), "last_seq").alias("last"),
            F.max_by(F.struct("last_parent", "parent_seq"), "parent_seq").alias("parent"),
        )
    )
    return merged.select("id", "first.*", "last.*", "parent.*").select(*COMMENT_STATE)


def merge_comments(
    current: DataFrame | None, updates: DataFrame, keep_parent: bool = False, keep_state: bool = False
) -> DataFrame:
    """Upsert of ``updates`` into ``current`` (a former result with ``keep_state``, or None).

    A user's history delivers comments without their parents, and the last delivery wins: ``keep_parent`` keeps the
    last parent known instead.
    """
    states = [comment_state(updates)] if current is None else [current, comment_state(updates)]
    merged = merge_comment_states(*states)
    if keep_parent:
        merged = merged.withColumn("parent_comment_id", F.col("last_parent"))
    return merged if keep_state else merged.select(*COMMENT_COLUMNS)

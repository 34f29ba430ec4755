"""Types of users: flair first, unambiguous declarations in comments second."""

from __future__ import annotations

from pyspark.sql import DataFrame

from typelore.operators import declarations as D


def users_with_type(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Users with ``mbti_type_from_flair_text``, ``mbti_type_from_comments`` and the resolved ``mbti_type``.

    One scan of the comments, of which only three columns are read. One row per declaring user leaves it.
    """
    declared = D.unambiguous_type(D.with_extracted_type(comments).select("user_id", "extracted_mbti"))
    joined = D.attach_comment_type(D.type_from_flair(users), declared).drop("user_id")
    return D.resolve_type(D.rename_sources(joined))


def type_counts(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Users per resolved type."""
    return D.count_by_type(users_with_type(comments, users))

"""Schemas of the persisted and landed tables."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("flair_text", T.StringType(), True),
    ]
)

COMMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("parent_submission_id", T.StringType(), True),
        T.StructField("parent_comment_id", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("content", T.StringType(), False),
        T.StructField("created_datetime", T.TimestampType(), False),
        T.StructField("upvotes", T.LongType(), False),
        T.StructField("subreddit", T.StringType(), False),
        T.StructField("submission_flair_text", T.StringType(), True),
    ]
)

PEOPLE = T.StructType(
    [
        T.StructField("type", T.StringType(), True),
        T.StructField("posts", T.StringType(), True),
    ]
)

CRAWL_PLAN = T.StructType(
    [
        T.StructField("subreddit", T.StringType(), False),
        T.StructField("n_hot", T.IntegerType(), False),
        T.StructField("flairs", T.ArrayType(T.StringType(), False), True),
    ]
)

UNPARSED = "_unparsed"

#: One landed submission, without its comments: their nesting has no bound.
THREAD = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("subreddit", T.StringType(), True),
        T.StructField("hot_rank", T.LongType(), True),
        T.StructField("is_self", T.BooleanType(), True),
        T.StructField("num_comments", T.LongType(), True),
        T.StructField("link_flair_text", T.StringType(), True),
        T.StructField("author_id", T.StringType(), True),
        T.StructField("author_name", T.StringType(), True),
        T.StructField("author_flair_text", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("selftext", T.StringType(), True),
        T.StructField("created_utc", T.LongType(), True),
        T.StructField("score", T.LongType(), True),
        T.StructField(UNPARSED, T.StringType(), True),
    ]
)

"""Choice of submissions, thread edges, user history, and table checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions.skew import salted_join
from typelore.functions.top_n import first_n_per_group
from typelore.sources.crawl_plan import CRAWL_PLAN, CrawlTarget, crawl_plan


def hot_top_n(
    submissions: DataFrame, plan: Sequence[CrawlTarget] = CRAWL_PLAN, salts: int = 32
) -> DataFrame:
    """First ``n_hot`` submissions of each planned forum, in the order of ``hot_rank``.

    One forum may hold most submissions: it is cut to the plan's largest ``n_hot`` in parts first.
    """
    targets = crawl_plan(submissions.sparkSession, plan).select("subreddit", "n_hot")
    planned = submissions.join(targets, "subreddit")
    largest = max(t.n_hot for t in plan)
    order = [F.col("hot_rank"), F.col("id")]
    ranked = first_n_per_group(planned, ["subreddit"], order, largest, salts=salts, rank_col="_rank")
    return ranked.filter(F.col("_rank") <= F.col("n_hot")).select(*submissions.columns)


def select_submissions(submissions: DataFrame, plan: Sequence[CrawlTarget] = CRAWL_PLAN) -> DataFrame:
    """Text submissions with comments whose flair is absent or listed; without a list only flairless ones pass."""
    targets = crawl_plan(submissions.sparkSession, plan).select("subreddit", "flairs")
    listed = F.coalesce(F.array_contains("flairs", F.col("link_flair_text")), F.lit(False))
    return (
        submissions.join(targets, "subreddit")
        .filter(
            F.col("is_self") & (F.col("num_comments") > 0) & (F.col("link_flair_text").isNull() | listed)
        )
        .select(*submissions.columns)
    )


def drop_authorless(items: DataFrame) -> DataFrame:
    return items.filter(F.col("user_id").isNotNull())


def authorless(items: DataFrame) -> DataFrame:
    """The records that ``drop_authorless`` leaves out, for a warning count or a side table."""
    return items.filter(F.col("user_id").isNull())


def flatten_threads(items: DataFrame, salts: int = 8) -> DataFrame:
    """Authored rows of an edge table; a row whose parent has no author gets no parent.

    The parents are reduced to distinct authored ids first, so copies of a parent do not repeat its children. One
    submission may be the parent of most rows, hence the salted join.
    """
    authored = drop_authorless(items)
    parents = authored.select(F.col("id").alias("parent_comment_id"), F.lit(True).alias("_authored")).distinct()
    joined = salted_join(authored, parents, ["parent_comment_id"], "left", salts, ["id"])
    parent = F.when(F.col("_authored"), F.col("parent_comment_id"))
    return joined.withColumn("parent_comment_id", parent).select(*items.columns)


def user_history(items: DataFrame, n: int) -> DataFrame:
    """First ``n`` hot submissions and first ``n`` hot comments of each user.

    Comments arrive without title and parent, submissions without parent and with themselves as root.
    """
    kept = first_n_per_group(items, ["user_id", "kind"], [F.col("hot_rank"), F.col("id")], n)
    is_submission = F.col("kind") == "submission"
    return (
        kept.withColumn("title", F.when(is_submission, F.col("title")))
        .withColumn(
            "parent_submission_id", F.when(is_submission, F.col("id")).otherwise(F.col("parent_submission_id"))
        )
        .withColumn("parent_comment_id", F.lit(None).cast("string"))
    )


def normalise_nulls(comments: DataFrame) -> DataFrame:
    """An empty submission flair means none."""
    flair = F.nullif(F.col("submission_flair_text"), F.lit(""))
    return comments.withColumn("submission_flair_text", flair)


def created_datetime(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def format_created(epoch: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session's zone, which ``build_session`` pins to UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def with_created_datetime(items: DataFrame) -> DataFrame:
    return items.withColumn("created_datetime", created_datetime(F.col("created_utc"))).drop("created_utc")


REQUIRED = {
    "comments": ("id", "user_id", "content", "created_datetime", "upvotes", "subreddit"),
    "users": ("id", "name"),
}


def _null_checks(table: DataFrame, name: str) -> DataFrame:
    """Missing values of every required column in one scan."""
    columns = REQUIRED[name]
    counts = table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    named = [F.struct(F.lit(f"{name}.{c} not null").alias("check"), F.col(c).alias("violations")) for c in columns]
    return counts.select(F.inline(F.array(*named)))


def _key_check(table: DataFrame, name: str) -> DataFrame:
    """Rows too many per id, counted after map-side counts per id."""
    copies = table.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return copies.agg(
        F.lit(f"{name}.id unique").alias("check"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"),
    )


def _reference_check(child: DataFrame, column: str, parent: DataFrame, label: str) -> DataFrame:
    """Rows whose key is not found, counted per key before the join so that a frequent key costs one row."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    missing = keys.join(parent.select("id"), "id", "left_anti")
    return missing.agg(
        F.lit(label).alias("check"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")
    )


def check_integrity(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Report with the number of violations of every declared key, NOT NULL and reference."""
    checks = [
        _null_checks(comments, "comments"),
        _null_checks(users, "users"),
        _key_check(comments, "comments"),
        _key_check(users, "users"),
        _reference_check(comments, "user_id", users, "comments.user_id in users.id"),
        _reference_check(comments, "parent_comment_id", comments, "comments.parent_comment_id in comments.id"),
    ]
    return reduce(DataFrame.unionByName, checks)

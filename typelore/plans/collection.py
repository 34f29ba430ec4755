"""From landed threads to the two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typelore.operators import ingest, merge
from typelore.sources.crawl_plan import CRAWL_PLAN, CrawlTarget
from typelore.sources.threads import flatten_nested


def collect(items: DataFrame, current_users: DataFrame | None = None, current_comments: DataFrame | None = None,
            keep_state: bool = False) -> tuple[DataFrame, DataFrame]:
    """Users and comments after merging the flattened ``items`` (with ``seq``) into the current tables."""
    authored = ingest.normalise_nulls(ingest.with_created_datetime(ingest.drop_authorless(items)))
    users = authored.select(
        F.col("user_id").alias("id"), F.col("user_name").alias("name"),
        F.col("user_flair_text").alias("flair_text"), "seq",
    )
    return (
        merge.merge_users(current_users, users, keep_state),
        merge.merge_comments(current_comments, authored, keep_state=keep_state),
    )


def collect_hot(threads: DataFrame, plan: Sequence[CrawlTarget] = CRAWL_PLAN) -> tuple[DataFrame, DataFrame]:
    """Users and comments of the hot threads of the planned forums, as they were landed."""
    hot = ingest.select_submissions(ingest.hot_top_n(threads, plan), plan)
    return collect(flatten_nested(hot))

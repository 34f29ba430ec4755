"""The forums to read, how many hot submissions of each, and the submission flairs to keep."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from typelore import schemas


class CrawlTarget(NamedTuple):
    subreddit: str
    n_hot: int
    flairs: tuple[str, ...] | None = None


# ---- Fixed values ------------------------------------------------------------------------------------------------

CRAWL_PLAN = (
    CrawlTarget(
        "infj",
        190,
        ("Ask INFJs", "What do you think?*", "Personality Theory", "Self Improvement*", "Mental Health"),
    ),
    CrawlTarget("intj", 110, ("Discussion", "Advice", "Question", "MBTI", "Relationship")),
    CrawlTarget("isfp", 170),
    CrawlTarget("istp", 140),
    CrawlTarget("INTP", 180),
    CrawlTarget(
        "infp",
        320,
        (
            "Discussion",
            "Mental Health",
            "Informative",
            "Venting",
            "Advice",
            "Random Thoughts",
            "MBTI/Typing",
            "Relationships",
        ),
    ),
    CrawlTarget("isfj", 140, ("Discussion", "Question or Advice")),
    CrawlTarget("ISTJ", 130),
    CrawlTarget(
        "entj",
        170,
        ("Career", "Discussion", "Poll", "Functions", "Dating|Relationships", "Appreciation Post"),
    ),
    CrawlTarget("enfj", 140, ("Advice", "Question", "Wholesome")),
    CrawlTarget("ESFP", 200, ("ESFP", "Other", "Question", "Advice", "Relationships")),
    CrawlTarget(
        "estp",
        300,
        ("ESTP Responses Only", "General Discussion", "Type Comparison Discussion", "Ask An ESTP"),
    ),
    CrawlTarget(
        "entp",
        190,
        ("Debate/Discussion", "Typology Help", "Advice", "Question/Poll", "MBTI Trends"),
    ),
    CrawlTarget("ENFP", 150),
    CrawlTarget("ESFJ", 250, ("Relationships", "Advice / Support", "Discussion / Poll")),
    CrawlTarget("ESTJ", 200, ("Discussion/Poll", "Question/Advice", "Relationships")),
    CrawlTarget(
        "MBTIDating",
        400,
        ("all types welcome", "looking for ENFP", "looking for INFJ", "looking for ENTJ", "looking for ENTP"),
    ),
    CrawlTarget("mbti", 560, ("Theory Question", "Survey/Poll", "Stereotypes")),
)


_ARROW = pa.schema([("subreddit", pa.string()), ("n_hot", pa.int32()), ("flairs", pa.list_(pa.string()))])


def crawl_plan(spark: SparkSession, plan: Sequence[CrawlTarget] = CRAWL_PLAN) -> DataFrame:
    """The plan as a table: one row per forum, ``flairs`` NULL where no list is given.

    Made from an Arrow table it is a local relation of known size, so joins with it become broadcast joins by Spark's
    own size check.
    """
    rows = [{"subreddit": t.subreddit, "n_hot": t.n_hot, "flairs": t.flairs and list(t.flairs)} for t in plan]
    return spark.createDataFrame(pa.Table.from_pylist(rows, _ARROW), schemas.CRAWL_PLAN)

"""Counts per person: posts, links, punctuation, emojis, and the letters of the type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.functions.text import count_matches, remove_urls


def split_posts(people: DataFrame) -> DataFrame:
    """``posts`` as array; empty posts are kept, and an empty text is one empty post."""
    return people.withColumn("posts", F.split("posts", r"\|\|\|"))


def posts_count(people: DataFrame) -> DataFrame:
    return people.withColumn("posts_count", F.size("posts"))


def posts_without_urls(people: DataFrame) -> DataFrame:
    return people.withColumn("posts_without_urls", F.transform("posts", remove_urls))


def _as_one_text(posts: str) -> Column:
    """Posts joined by line breaks.

    No URL, punctuation mark or emoji contains a line break, and all of them treat one like the end of the text, so
    that counting in the joined text gives the sum over the posts. One search over one text stays in generated code,
    where an expression per array element would not.
    """
    return F.array_join(posts, "\n")


def urls_count(people: DataFrame) -> DataFrame:
    return people.withColumn("urls_count", count_matches(_as_one_text("posts"), P.URL))


def punctuations_count(people: DataFrame) -> DataFrame:
    return people.withColumn("punctuations_count", count_matches(_as_one_text("posts_without_urls"), P.PUNCTUATION))


def emojis_count(people: DataFrame, mode: str = "effective") -> DataFrame:
    return people.withColumn("emojis_count", count_matches(_as_one_text("posts_without_urls"), P.EMOJI[mode]))


def count_means(people: DataFrame) -> DataFrame:
    """Each ``<things>_count`` but the number of posts, divided by it, as ``mean_<thing>_count``."""
    counts = [c for c in people.columns if c.endswith("_count") and c != "posts_count" and not c.startswith("mean_")]
    means = {
        f"mean_{c.split('_')[0][:-1]}_count": F.try_divide(F.col(c), F.col("posts_count")).cast("double")
        for c in counts
    }
    return people.withColumns(means)


def dichotomies(people: DataFrame) -> DataFrame:
    """One 0/1 flag per letter pair."""
    return people.withColumns(
        {flag: (F.substring("type", at, 1) == one).cast("int") for flag, one, _, at in P.DICHOTOMIES}
    )


def type_counts(people: DataFrame) -> DataFrame:
    """People per type, most frequent first."""
    return (
        people.filter(F.col("type").isNotNull())
        .groupBy("type")
        .agg(F.count("*").alias("people"))
        .orderBy(F.desc("people"), "type")
    )


def profile(df: DataFrame) -> DataFrame:
    """Name, number of values and type of every column."""
    types = dict(df.dtypes)
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).unpivot([], df.columns, "column", "non_null")
    dtype = F.lit("")
    for name in df.columns:
        dtype = F.when(F.col("column") == name, types[name]).otherwise(dtype)
    return counts.withColumn("dtype", dtype)


def person_features(people: DataFrame, emoji_mode: str = "effective") -> DataFrame:
    """All counts, means and flags of a person from the delimited ``posts``, without a shuffle.

    The text is scanned where it stands: the delimiter becomes a line break, and the array of posts is not built.
    """
    text = F.replace(F.col("posts"), F.lit(P.POST_DELIMITER), F.lit("\n"))
    delimiters = F.regexp_count("posts", F.lit(r"\|\|\|"))
    counted = (
        people.withColumn("_text", text)
        .withColumn("_plain", F.when(F.col("_text").contains("http"), remove_urls(F.col("_text"))).otherwise(F.col("_text")))
        .select(
            "person_id",
            "type",
            (delimiters + 1).alias("posts_count"),
            F.when(F.col("_text").contains("http"), count_matches(F.col("_text"), P.URL))
            .otherwise(F.when(F.col("_text").isNotNull(), 0))
            .alias("urls_count"),
            count_matches(F.col("_plain"), P.PUNCTUATION).alias("punctuations_count"),
            count_matches(F.col("_plain"), P.EMOJI[emoji_mode]).alias("emojis_count"),
        )
    )
    return dichotomies(count_means(counted))

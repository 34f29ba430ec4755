"""Statistics per type, per letter, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions import patterns as P

MEANS = ("mean_url_count", "mean_punctuation_count", "mean_emoji_count")
STATS = ("group", "individuals", "posts", *MEANS)


def letter(flag: str) -> Column:
    """Letter that a 0/1 flag stands for."""
    one, zero = next((o, z) for f, o, z, _ in P.DICHOTOMIES if f == flag)
    return F.when(F.col(flag) == 1, one).when(F.col(flag) == 0, zero)


def type_letter(column: str, at: int, one: str, zero: str) -> Column:
    """One of two letters by position ``at`` of a type code."""
    return F.when(F.col(column).isNotNull(), F.when(F.substring(column, at, 1) == one, one).otherwise(zero))


def groups_of_type(column: str, grains: tuple[str, ...] = ("type", "letter")) -> Column:
    """Array of the groups a type belongs to: itself and its four letters."""
    groups = [F.col(column)] if "type" in grains else []
    if "letter" in grains:
        groups += [type_letter(column, at, one, zero) for _, one, zero, at in P.DICHOTOMIES]
    return F.array(*groups)


def _sums() -> list[Column]:
    sums = [F.count("*").alias("individuals"), F.sum("posts_count").alias("posts")]
    for mean in MEANS:
        sums += [F.sum(mean).alias(f"{mean}_sum"), F.count(mean).alias(f"{mean}_n")]
    return sums


def _finish(sums: DataFrame) -> DataFrame:
    means = [F.try_divide(f"{m}_sum", f"{m}_n").alias(m) for m in MEANS]
    return sums.select("group", "individuals", F.col("posts").cast("long").alias("posts"), *means)


def group_stats(features: DataFrame, by: str = "type") -> DataFrame:
    """People, posts and unweighted means over people for each value of a column; flags appear as letters."""
    group = letter(by) if by in {d[0] for d in P.DICHOTOMIES} else F.col(by)
    return _finish(features.withColumn("group", group).filter(F.col("group").isNotNull()).groupBy("group").agg(*_sums()))


def dichotomy_stats(features: DataFrame) -> DataFrame:
    """Statistics per letter, all four pairs, in one scan."""
    return _per_group(features, ("letter",))


def summary(features: DataFrame) -> DataFrame:
    """Statistics per type and per letter in one scan.

    The people are summed per type first, at most 81 rows; each of these is then added to its type and its letters.
    """
    return _per_group(features, ("type", "letter"))


def _per_group(features: DataFrame, grains: tuple[str, ...]) -> DataFrame:
    per_type = features.filter(F.col("type").isNotNull()).groupBy("type").agg(*_sums())
    spread = per_type.withColumn("group", F.explode(groups_of_type("type", grains)))
    totals = [F.sum(c).alias(c) for c in per_type.columns if c != "type"]
    return _finish(spread.groupBy("group").agg(*totals))


def posts_table(people: DataFrame) -> DataFrame:
    """One row per post, numbered within the person.

    The outer form and the filter behind it stand in for the plain one, for which Spark would split every text a
    second time, to leave out empty arrays in front of it.
    """
    split = F.posexplode_outer(F.split("posts", r"\|\|\|")).alias("post_no", "post")
    return people.select("person_id", "type", split).filter(F.col("post").isNotNull())


def group_names(people: DataFrame, grains: tuple[str, ...] = ("type", "letter")) -> DataFrame:
    """The groups that people belong to, those without any term included, as ``group``. Reads no text."""
    if grains == ("person",):
        return people.select(F.col("person_id").alias("group")).distinct()
    types = people.select("type").filter(F.col("type").isNotNull()).distinct()
    return types.select(F.explode(groups_of_type("type", grains)).alias("group")).distinct()


def rank_groups(stats: DataFrame, metric: str) -> DataFrame:
    """Groups by rising ``metric``."""
    return stats.select("group", metric).orderBy(metric, "group")


def group_content(people: DataFrame, grains: tuple[str, ...] = ("type", "letter")) -> DataFrame:
    """All posts of each group as rows in the order (``person_id``, ``post_no``).

    Joined by blanks in that order they are the group's text, which is not built: one group may hold a third of
    everything that was written.
    """
    return posts_table(people).filter(F.col("type").isNotNull()).select(
        F.explode(groups_of_type("type", grains)).alias("group"), "person_id", "post_no", "post"
    )

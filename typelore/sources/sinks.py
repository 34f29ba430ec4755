"""Writers of the results. Every sink writes one file per partition and nothing through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_user_types(users: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``id, name, mbti_type`` as Parquet."""
    users.select("id", "name", "mbti_type").write.mode(mode).parquet(path)


def write_group_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Group statistics without the text, as CSV with header."""
    stats.drop("content").write.mode(mode).option("header", True).csv(path)


def write_word_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per word."""
    counts.select("token", "occurrences").write.mode(mode).json(path)


def write_stats_and_tokens(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Statistics with tokens at one grain, as Parquet."""
    table.write.mode(mode).parquet(path)

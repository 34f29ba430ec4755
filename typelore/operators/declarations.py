"""The type a user declares, in a flair or in a text, and how the two are brought together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.functions.text import first_match, unbold

MATCH_COLUMNS = tuple(f"{name}__on__{field}" for name, _, _ in P.DECLARATIONS for field in ("title", "content"))


def flair_type(flair: Column) -> Column:
    """First type named in a flair, in any case and also in mathematical bold; NULL if none or no flair."""
    return first_match(unbold(F.upper(flair)), P.TYPE, 0)


def type_from_flair(users: DataFrame) -> DataFrame:
    return users.withColumn("mbti_type", flair_type(F.col("flair_text")))


def lookup(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Rows with one id; the filter reaches the Parquet scan."""
    return df.filter(F.col(column) == value)


def count_by_type(users: DataFrame) -> DataFrame:
    """Users per type, most frequent first, users without type left out."""
    return (
        users.filter(F.col("mbti_type").isNotNull())
        .groupBy("mbti_type")
        .agg(F.count("id").alias("users"))
        .orderBy(F.desc("users"), "mbti_type")
    )


def _search(comments: DataFrame, names: Sequence[str]) -> DataFrame:
    """Comments with one more column per pattern and field.

    A text without any type code, which is the usual case, is told apart by one search shared by all patterns. The
    columns leave through a generator: what is done with them later, a filter above all, then reads their values
    instead of being merged with the search, which would run it again.
    """
    found = []
    for name, pattern, group in P.DECLARATIONS:
        for field in ("title", "content"):
            if name in names:
                match = F.regexp_extract(field, pattern, group)
                found.append(F.when(F.col(field).rlike(P.TYPE), match).alias(f"{name}__on__{field}"))
    searched = comments.select(*comments.columns, F.inline(F.array(F.struct(*found))))
    added = [c for c in searched.columns if c not in comments.columns]
    return searched.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in added})


def extract_declarations(comments: DataFrame, name: str) -> DataFrame:
    """Matches of one pattern on title and content."""
    found = _search(comments.select("id", "title", "content"), [name])
    return found.drop("title", "content")


def extract_all(comments: DataFrame) -> DataFrame:
    """Twelve columns in one scan: each pattern on the title, then on the content."""
    found = _search(comments.select("id", "title", "content"), [n for n, _, _ in P.DECLARATIONS])
    return found.select("id", *MATCH_COLUMNS)


def match_counts(matches: DataFrame) -> DataFrame:
    """Number of matches of each column, one row per column."""
    counts = matches.agg(*(F.count(c).alias(c) for c in MATCH_COLUMNS))
    return counts.unpivot([], list(MATCH_COLUMNS), "pattern", "matches")


def rows_with_k_matches(matches: DataFrame, k: int = 2) -> DataFrame:
    """Rows where exactly ``k`` of the twelve columns matched."""
    found = reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in MATCH_COLUMNS))
    return matches.filter(found == k)


def last_match(matches: DataFrame) -> DataFrame:
    """The last column that matched, in column order."""
    return matches.select("id", F.coalesce(*reversed(MATCH_COLUMNS)).alias("extracted_mbti"))


def with_extracted_type(comments: DataFrame) -> DataFrame:
    """Comments with the last match."""
    found = _search(comments, [n for n, _, _ in P.DECLARATIONS])
    return found.select(*comments.columns, F.coalesce(*reversed(MATCH_COLUMNS)).alias("extracted_mbti"))


def comments_with_user_type(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Inner join of comments with the type of their author; both ids are kept under distinct names.

    An author of very many comments makes a skewed partition on the comment side. Adaptive execution splits it if both
    sides come straight from their shuffles, so hand in merged users as a written table.
    """
    authors = users.select(F.col("id").alias("id_y"), "mbti_type")
    return comments.withColumnRenamed("id", "id_x").join(authors, F.col("user_id") == F.col("id_y"))


def _declared(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("extracted_mbti").isNotNull())


def types_per_user(comments: DataFrame) -> DataFrame:
    """Distinct types each user declared. A set cannot outgrow the 81 type codes, however many comments there are."""
    return _declared(comments).groupBy("user_id").agg(F.array_sort(F.collect_set("extracted_mbti")).alias("types"))


def ambiguous_users(comments: DataFrame) -> DataFrame:
    return types_per_user(comments).filter(F.size("types") > 1)


def unambiguous_type(comments: DataFrame) -> DataFrame:
    """Users who declared exactly one type, and that type: their smallest and largest are the same.

    The four letters of a code are compared as one number, which a hash aggregation can hold.
    """
    code = F.conv(F.hex("extracted_mbti"), 16, 10).cast("long")
    found = (
        _declared(comments).groupBy("user_id").agg(F.min(code).alias("_low"), F.max(code).alias("_high")).filter("_low = _high")
    )
    return found.select("user_id", F.unhex(F.hex("_low")).cast("string").alias("extracted_mbti"))


def attach_comment_type(users: DataFrame, declared: DataFrame) -> DataFrame:
    """Every user, with the unambiguous type from comments where there is one."""
    return users.join(declared, users["id"] == declared["user_id"], "left")


def rename_sources(users: DataFrame) -> DataFrame:
    return users.withColumnsRenamed(
        {"mbti_type": "mbti_type_from_flair_text", "extracted_mbti": "mbti_type_from_comments"}
    )


def resolve_type(users: DataFrame) -> DataFrame:
    """Type from the flair, else from comments."""
    return users.withColumn("mbti_type", F.coalesce("mbti_type_from_flair_text", "mbti_type_from_comments"))


def project_user_types(users: DataFrame) -> DataFrame:
    return users.select("id", "name", "mbti_type")


def project_comments(comments: DataFrame) -> DataFrame:
    return comments.select("id", "user_id", "parent_comment_id", "subreddit", "title", "content")


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First rows in the order of a key: every task keeps ``n`` rows, nothing is sorted as a whole."""
    return df.orderBy(order).limit(n)

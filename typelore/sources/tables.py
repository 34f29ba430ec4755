"""Readers and writers of the persisted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typelore import schemas


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Submissions and comments. Filters and column selections reach the Parquet scan."""
    return spark.read.schema(schemas.COMMENTS).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USERS).parquet(path)


def user_names(users: DataFrame) -> DataFrame:
    return users.select("name")


def read_people(
    spark: SparkSession, path: str, id_column: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with header, columns ``type`` and ``posts`` (posts joined by ``|||``), plus ``person_id``.

    ``id_column`` names an id that stands before the two columns in the file. Without it the id follows the order of
    files and rows; write the table to Parquet once to keep it. ``multi_line=True`` allows line breaks in quoted fields;
    each file is then read by one task, and malformed rows cannot be told apart.
    """
    ids = [] if id_column is None else [T.StructField(id_column, T.LongType(), True)]
    people = (
        spark.read.schema(T.StructType([*ids, *schemas.PEOPLE.fields]))
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    person_id = F.monotonically_increasing_id() if id_column is None else F.col(id_column)
    return people.select(person_id.alias("person_id"), "type", "posts")

"""Landed submissions with nested comment forests, and their flattening to rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typelore import schemas

ITEM_COLUMNS = (
    "id",
    "user_id",
    "user_name",
    "user_flair_text",
    "parent_submission_id",
    "parent_comment_id",
    "title",
    "content",
    "created_utc",
    "upvotes",
    "subreddit",
    "submission_flair_text",
    "seq",
)

_COMMENT = pa.schema(
    [
        ("id", pa.string()),
        ("user_id", pa.string()),
        ("user_name", pa.string()),
        ("user_flair_text", pa.string()),
        ("parent_comment_id", pa.string()),
        ("content", pa.string()),
        ("created_utc", pa.int64()),
        ("upvotes", pa.int64()),
        ("at", pa.int32()),
    ]
)
_ROWS_PER_BATCH = 5_000
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\]|\\.)*")|([^ \t\r\n{}\[\]:,"]+))', re.DOTALL)


def _parsed(lines: DataFrame, mode: str) -> DataFrame:
    options = {"mode": mode, "columnNameOfCorruptRecord": schemas.UNPARSED, "maxNestingDepth": str(2**31 - 1)}
    written = lines.filter(F.trim("value") != "")
    return written.select("value", F.from_json("value", schemas.THREAD, options).alias("thread"))


def read_threads(spark: SparkSession, path: str, skip_unparsed: bool = False) -> DataFrame:
    """JSON lines, one submission each; ``landed`` is the line, which holds the comments in any depth.

    A line that is no such record fails the read. With ``skip_unparsed`` these lines are left out; they are the rows of
    ``unparsed_threads``, to be counted or kept beside the rest.
    """
    found = _parsed(spark.read.text(path), "PERMISSIVE" if skip_unparsed else "FAILFAST")
    flat = found.select("thread.*", F.col("value").alias("landed"))
    if skip_unparsed:
        flat = flat.filter(F.col(schemas.UNPARSED).isNull())
    return flat.drop(schemas.UNPARSED)


def unparsed_threads(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_threads`` leaves out with ``skip_unparsed``, as ``value``."""
    return _parsed(spark.read.text(path), "PERMISSIVE").filter(F.col("thread").getField(schemas.UNPARSED).isNotNull()).select("value")


def _load(text: str):
    """A JSON value; where it is nested too deeply for the parser, it is put together with a stack."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    stack, key = [[]], []
    for mark, quoted, bare in _TOKEN.findall(text):
        if mark in ("{", "["):
            value = {} if mark == "{" else []
        elif mark in ("}", "]"):
            stack.pop()
            continue
        elif mark:
            continue
        else:
            value = json.loads(quoted or bare)
        holder = stack[-1]
        if isinstance(holder, list):
            holder.append(value)
        elif len(key) < len(stack):  # the name of a field; its value comes next
            key += [None] * (len(stack) - len(key) - 1) + [value]
            continue
        else:
            holder[key.pop()] = value
        if mark:
            stack.append(value)
            key += [None] * (len(stack) - 1 - len(key))
    return stack[0][0]


def _comments(landed: str, root: str | None) -> Iterator[tuple]:
    """Comments of a thread, each before its replies. The children of an authorless comment get no parent.

    A "more" node only stands for further comments of the same parent, so it hands its own parent on and is no row.
    """
    open_ = [(root, comment) for comment in reversed(_load(landed).get("comments") or [])]
    at = 0
    while open_:
        parent, node = open_.pop()
        if node is None:
            continue
        below = parent
        if node.get("kind") != "more":
            at += 1
            author = node.get("author_id")
            below = node.get("id") if author is not None else None
            yield (
                node.get("id"), author, node.get("author_name"), node.get("author_flair_text"), parent,
                node.get("body"), node.get("created_utc"), node.get("score"), at,
            )
        open_ += [(below, reply) for reply in reversed(node.get("replies") or [])]


def flatten_nested(threads: DataFrame) -> DataFrame:
    """One row per submission and comment, authorless ones included (``user_id`` NULL), parents re-rooted.

    Nesting may be of any depth: each thread is walked once, where it lies, and its rows leave in parts. ``seq`` is the
    order of arrival: by ``hot_rank`` and id of the thread, and within it depth first, the submission at 0.
    """
    parent = F.when(F.col("author_id").isNotNull(), F.col("id"))
    rank = F.coalesce(F.col("hot_rank").cast("long"), F.lit(0).cast("long"))
    seq = F.struct(rank.alias("rank"), F.col("id").alias("thread"), F.lit(0).alias("at"))
    submissions = threads.select(
        "id", F.col("author_id").alias("user_id"), F.col("author_name").alias("user_name"),
        F.col("author_flair_text").alias("user_flair_text"), F.col("id").alias("parent_submission_id"),
        F.lit(None).cast("string").alias("parent_comment_id"), "title", F.col("selftext").alias("content"), "created_utc",
        F.col("score").alias("upvotes"), "subreddit", F.col("link_flair_text").alias("submission_flair_text"), seq.alias("seq"),
    )
    kept = ("rank", "thread", "subreddit", "submission_flair_text")
    nested = threads.select(
        rank.alias("rank"), F.col("id").alias("thread"), "subreddit", F.col("link_flair_text").alias("submission_flair_text"),
        parent.alias("root"), "landed",
    )
    thread = pa.schema([("rank", pa.int64()), *((name, pa.string()) for name in kept[1:])])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                part = []

                def packed(part=part, one=one):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _COMMENT, strict=True)]
                    same = [pa.array([one[f.name]] * len(part), f.type) for f in thread]
                    return pa.RecordBatch.from_arrays([*same, *columns], [*thread.names, *_COMMENT.names])

                for comment in _comments(one["landed"], one["root"]):
                    part.append(comment)
                    if len(part) == _ROWS_PER_BATCH:
                        yield packed()
                        part.clear()
                if part:
                    yield packed()

    fields = [*nested.select(*kept).schema.fields]
    types = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.int32(): T.IntegerType()}
    fields += [T.StructField(f.name, types[f.type]) for f in _COMMENT]
    comments = nested.mapInArrow(walk, T.StructType(fields)).select(
        "id", "user_id", "user_name", "user_flair_text", F.col("thread").alias("parent_submission_id"), "parent_comment_id",
        F.lit(None).cast("string").alias("title"), "content", "created_utc", "upvotes", "subreddit", "submission_flair_text",
        F.struct("rank", "thread", "at").alias("seq"),
    )
    return submissions.unionByName(comments).select(*ITEM_COLUMNS)

"""The given tables seen as the tables this library works on.

Forum comments and user flairs come from ``conversations``, hot listings from ``events``, people with their posts from
``documents``. The texts name no types, links or emoticons, so these are added by row. Every view is a projection of
each row by itself: nothing is grouped, and all rows and whole texts are used. The statements are plain SQL that reads
the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.sources.crawl_plan import CRAWL_PLAN


def _type_code(number: str) -> str:
    pairs = (("I", "E", 1), ("S", "N", 2), ("F", "T", 4), ("J", "P", 8))
    return " || ".join(f"(CASE WHEN ({number} & {bit}) = 0 THEN '{a}' ELSE '{b}' END)" for a, b, bit in pairs)


# u: number of the author; one author in six rows is number 7
BASE = f"""
SELECT *, {_type_code('u')} AS t1, (CASE WHEN (u & 1) = 0 THEN 'E' ELSE 'I' END) || 'NTP' AS t2
FROM (SELECT *, CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN 7 ELSE conv_id * 2 + turn % 3 END AS u
      FROM conversations) b0
"""

# every row, those without author included
ITEMS = """
SELECT 'c' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id,
  CASE WHEN (conv_id + turn) % 13 = 12 THEN NULL ELSE 'u' || CAST(u AS STRING) END AS user_id,
  CASE WHEN (conv_id + turn) % 13 = 12 THEN NULL ELSE 'name_' || CAST(u AS STRING) END AS user_name,
  CASE (u + turn) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN lower(t1) || ' | 25F'
    WHEN 3 THEN translate(t1, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{bold}') || ' fan'
    WHEN 4 THEN t1 || '/' || t2 ELSE NULL END AS user_flair_text,
  'c' || CAST(conv_id AS STRING) || '_0' AS parent_submission_id,
  CASE WHEN turn = 0 THEN NULL
       ELSE 'c' || CAST(conv_id AS STRING) || '_' || CAST(turn - 1 AS STRING) END AS parent_comment_id,
  CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN t1 || ' looking for friends'
       WHEN turn = 0 THEN 'thread ' || CAST(conv_id AS STRING) ELSE NULL END AS title,
  (CASE (conv_id + turn) % 8
     WHEN 0 THEN 'I am an ' || t1 || '. '      WHEN 1 THEN 'I' || chr(39) || 'm ' || t1 || '. '
     WHEN 2 THEN 'my ' || t1 || ' personality. ' WHEN 3 THEN t1 || ' (f) here. '
     WHEN 4 THEN 'Fellow ' || t1 || '. '
     WHEN 5 THEN 'Me (' || (CASE WHEN conv_id % 3 = 0 THEN t2 ELSE t1 END) || ') '
     WHEN 6 THEN '> quoted bc line' || chr(10) || '[View Poll](https://www.a.com/poll/1) bc ' ELSE '' END)
  || text
  || (CASE (conv_id + 2 * turn) % 5 WHEN 0 THEN ' see https://www.a-b.com/x?y=1&z :)'
     WHEN 1 THEN ' :smile: ok' WHEN 2 THEN ' http://ab.co/q!' ELSE '' END) AS content,
  1612137600 + conv_id * 3600 + turn * 60 AS created_utc,
  (conv_id * 7 + turn * 13) % 50 AS upvotes,
  'sub' || CAST(conv_id % 18 AS STRING) AS subreddit,
  CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Advice' WHEN 2 THEN 'Discussion' ELSE '' END AS submission_flair_text,
  conv_id * 1000000 + turn AS seq
FROM base
""".replace("{bold}", P.BOLD_CAPITALS)

# deliveries: each authored row once, every third one again later, changed and without its parent
DELIVERIES = """
SELECT * FROM items WHERE user_id IS NOT NULL
UNION ALL
SELECT id, 'later_' || user_id AS user_id, user_name, user_flair_text, 'later_' || id AS parent_submission_id,
  NULL AS parent_comment_id, 'later ' || title AS title, 'edited: ' || content AS content,
  created_utc + 5 AS created_utc, upvotes + 1000 AS upvotes, 'later' AS subreddit,
  CASE WHEN upvotes % 2 = 0 THEN 'later' ELSE NULL END AS submission_flair_text,
  seq + 1000000000000 AS seq
FROM items WHERE user_id IS NOT NULL AND upvotes % 3 = 0
"""

_NAMES = " ".join(f"WHEN {i} THEN '{t.subreddit}'" for i, t in enumerate(CRAWL_PLAN))

# a third of the submissions stand in the last forum of the plan
SUBMISSIONS = f"""
SELECT 'e' || CAST(event_id AS STRING) AS id,
  CASE event_id % 27 {_NAMES} ELSE '{CRAWL_PLAN[-1].subreddit}' END AS subreddit,
  event_id AS hot_rank, event_id % 10 <> 3 AS is_self, event_id % 4 AS num_comments,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Discussion' WHEN 2 THEN 'Advice' WHEN 3 THEN 'Question'
    WHEN 4 THEN 'Survey/Poll' WHEN 5 THEN 'Relationships' ELSE 'Meme' END AS link_flair_text,
  'u' || CAST(user_id AS STRING) AS author_id, event_type AS title
FROM events
"""

# a landed thread per row of conversations, in the same forums
THREADS = f"""
SELECT 't' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id,
  CASE conv_id % 18 {_NAMES} END AS subreddit, conv_id * 16 + turn AS hot_rank, (conv_id + turn) % 10 <> 3 AS is_self,
  (conv_id + turn) % 4 AS num_comments,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'Discussion' WHEN 1 THEN 'Advice' WHEN 2 THEN 'Survey/Poll' ELSE NULL END
    AS link_flair_text,
  CASE WHEN (conv_id + turn) % 7 <> 6 THEN 'u' || CAST((conv_id + turn) % 11 AS STRING) ELSE NULL END AS author_id,
  CASE WHEN (conv_id + turn) % 7 <> 6 THEN 'name_' || CAST((conv_id + turn) % 11 AS STRING) ELSE NULL END AS author_name,
  CASE WHEN turn = 2 THEN 'INFP' WHEN turn = 4 THEN '' ELSE NULL END AS author_flair_text,
  'thread t' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS title, role AS selftext,
  1612137600 + conv_id + turn AS created_utc, (conv_id + turn) % 50 AS score, text, conv_id + turn AS number
FROM conversations
"""

# items of users' own listings
HISTORY = """
SELECT 'e' || CAST(event_id AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS user_id,
  CASE WHEN event_id % 2 = 0 THEN 'submission' ELSE 'comment' END AS kind, event_id AS hot_rank,
  'e' || CAST(event_id - event_id % 10 AS STRING) AS parent_submission_id,
  'e' || CAST(event_id - 1 AS STRING) AS parent_comment_id, event_type AS title
FROM events
"""

# a third of the people have the same type; each line of a document is a post
PEOPLE = f"""
SELECT doc_id AS person_id,
  CASE WHEN doc_id % 3 = 0 THEN 'INFP' ELSE {_type_code('(doc_id % 97)')} END AS type,
  replace(
    (CASE doc_id % 7 WHEN 0 THEN 'http://ab.co/q! ' WHEN 3 THEN 'so happy :) or 8) I cannot ' ELSE '' END)
    || text
    || (CASE doc_id % 5 WHEN 0 THEN ' see https://www.a-b.com/x?y=1&z :)' WHEN 1 THEN ' :smile: ok'
        WHEN 2 THEN ' gonna wait: <3' WHEN 3 THEN ' :-P' ELSE '' END),
    chr(10), '|||') AS posts
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _view(spark: SparkSession, statement: str, name: str, source: DataFrame) -> DataFrame:
    return spark.sql(statement.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: source})


def items_of(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Works on a stream as well."""
    base = _view(spark, BASE, "conversations", conversations)
    return _view(spark, ITEMS, "base", base)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spark, table(spark, sf_dir, "conversations"))


def deliveries_of(spark: SparkSession, all_items: DataFrame) -> DataFrame:
    return _view(spark, DELIVERIES, "items", all_items)


def comment_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = deliveries_of(spark, items(spark, sf_dir))
    return deliveries.withColumn("created_datetime", F.timestamp_seconds("created_utc"))


def user_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    authored = items(spark, sf_dir).filter(F.col("user_id").isNotNull())
    return authored.select(
        F.col("user_id").alias("id"), F.col("user_name").alias("name"), F.col("user_flair_text").alias("flair_text"), "seq"
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, SUBMISSIONS, "events", table(spark, sf_dir, "events"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, HISTORY, "events", table(spark, sf_dir, "events"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, PEOPLE, "documents", table(spark, sf_dir, "documents"))


def thread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed threads as JSON text: each conversation row is a submission, its lines a chain of replies.

    Every fifth line is a "more" node; submissions and lines without author occur, and the flair of an author changes
    along the chain.
    """
    rows = _view(spark, THREADS, "conversations", table(spark, sf_dir, "conversations"))

    def opened(line, k):
        number = F.col("number") + k
        authored = (k % 5 != 3) & (number % 6 != 5)
        named = (number % 11).cast("string")
        node = F.struct(
            F.concat("id", F.lit("_"), k.cast("string")).alias("id"),
            F.when(k % 5 == 3, "more").otherwise("comment").alias("kind"),
            F.when(authored, F.concat(F.lit("u"), named)).alias("author_id"),
            F.when(authored, F.concat(F.lit("name_"), named)).alias("author_name"),
            F.when(k % 3 == 1, "ENTJ").when(k % 3 == 2, "ISTP").alias("author_flair_text"),
            line.alias("body"),
            (F.lit(1612137600) + number).alias("created_utc"),
            (number % 50).alias("score"),
        )
        return F.concat(F.regexp_replace(F.to_json(node), r"\}$", ""), F.lit(',"replies":['))

    lines = F.split("text", "\n")
    submission = F.struct(*(c for c in rows.columns if c not in ("text", "number")))
    return rows.select(
        F.concat(
            F.regexp_replace(F.to_json(submission), r"\}$", ""),
            F.lit(',"comments":['),
            F.array_join(F.transform(lines, opened), ""),
            F.expr("repeat(']}', size(split(text, '\\n')))"),
            F.lit("]}"),
        ).alias("value")
    )

import json
import random

import pytest
from pyspark.sql import functions as F

from typelore.operators import ingest as B
from typelore.plans.collection import collect
from typelore.sources import tables
from typelore.sources import threads as T
from typelore.sources.crawl_plan import CRAWL_PLAN, CrawlTarget, crawl_plan

SUBMISSIONS = "id string, subreddit string, hot_rank long, is_self boolean, num_comments long, link_flair_text string"


def test_plan(spark):
    plan = crawl_plan(spark)
    assert plan.count() == 18 and plan.filter("flairs IS NOT NULL").count() == 13
    assert {t.subreddit for t in CRAWL_PLAN if t.flairs is None} == {"isfp", "istp", "INTP", "ISTJ", "ENFP"}


@pytest.mark.parametrize("salts", [1, 4])
def test_hot_top_n_cuts_before_it_selects(spark, salts):
    plan = (CrawlTarget("a", 3, ("x",)), CrawlTarget("b", 5), CrawlTarget("c", 2))
    rng = random.Random(salts)
    ranks = {"a": 400, "b": 4, "z": 9}
    data = [(f"{s}{i}", s, i, True, 1, rng.choice([None, "x"])) for s, n in ranks.items() for i in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, SUBMISSIONS).repartition(8)
    hot = B.hot_top_n(df, plan, salts=salts)
    assert sorted(r["id"] for r in hot.collect()) == ["a0", "a1", "a2", "b0", "b1", "b2", "b3"]
    assert hot.columns == df.columns


@pytest.mark.parametrize(
    "subreddit, is_self, comments, flair, kept",
    [
        ("a", True, 1, None, True),
        ("a", True, 1, "x", True),
        ("a", True, 1, "y", False),
        ("b", True, 1, None, True),
        ("b", True, 1, "x", False),
        ("a", False, 1, None, False),
        ("a", True, 0, None, False),
    ],
)
def test_select_submissions(spark, subreddit, is_self, comments, flair, kept):
    plan = (CrawlTarget("a", 3, ("x",)), CrawlTarget("b", 5))
    df = spark.createDataFrame([("1", subreddit, 0, is_self, comments, flair)], SUBMISSIONS)
    assert (B.select_submissions(df, plan).count() == 1) is kept


def test_flatten_edges(spark, rows):
    items = spark.createDataFrame(
        [("A", "u", None), ("B", None, "A"), ("C", "u", "B"), ("D", "u", "C"), ("E", "u", "A"), ("A", "u", None)],
        "id string, user_id string, parent_comment_id string",
    )
    flat = B.flatten_threads(items)
    assert rows(flat) == sorted(
        [("A", "u", None), ("A", "u", None), ("C", "u", None), ("D", "u", "C"), ("E", "u", "A")], key=repr
    )
    assert [r["id"] for r in B.authorless(items).collect()] == ["B"]


def _node(cid, author="u", replies=(), kind=None):
    node = {"id": cid, "author_id": author, "body": f"text {cid}", "created_utc": 1, "score": 2, "replies": list(replies)}
    return {**node, "kind": kind} if kind else node


def _thread(tid, author, comments):
    return {"id": tid, "subreddit": "s", "author_id": author, "title": "t", "selftext": "x", "created_utc": 1, "score": 1,
            "comments": comments}


def _write(spark, path, threads):
    spark.createDataFrame([(json.dumps(t),) for t in threads], "value string").write.text(path)


def test_flatten_nested_cases(spark, tmp_path):
    path = str(tmp_path / "threads")
    more = _node("m1", None, [_node("m2", None, [_node("g")], kind="more"), _node("h")], kind="more")
    _write(
        spark,
        path,
        [
            _thread("S", "u", [_node("a", "u", [_node("b", None, [_node("c", "u", [_node("d")])])]), _node("e", "u", [more])]),
            _thread("N", None, [_node("f"), more]),
            _thread("Z", "u", []),
        ],
    )
    flat = T.flatten_nested(T.read_threads(spark, path))
    found = {(r["parent_submission_id"], r["id"]): (r["user_id"], r["parent_comment_id"]) for r in flat.collect()}
    assert found == {
        ("S", "S"): ("u", None),
        ("S", "a"): ("u", "S"),
        ("S", "b"): (None, "a"),
        ("S", "c"): ("u", None),
        ("S", "d"): ("u", "c"),
        ("S", "e"): ("u", "S"),
        ("S", "g"): ("u", "e"),
        ("S", "h"): ("u", "e"),
        ("N", "N"): (None, None),
        ("N", "f"): ("u", None),
        ("N", "g"): ("u", None),
        ("N", "h"): ("u", None),
        ("Z", "Z"): ("u", None),
    }
    authored = B.drop_authorless(flat)
    ids = {r["id"] for r in authored.collect()}
    assert {r["parent_comment_id"] for r in authored.collect()} - {None} <= ids


def _chain(depth, tail='"replies":[]}'):
    opened = "".join(f'{{"id":"n{i}","author_id":"u","body":"\\"[x\\\\","replies":[' for i in range(depth - 1))
    return f'{opened}{{"id":"n{depth - 1}","author_id":"u",{tail}' + "]}" * (depth - 1)


@pytest.mark.parametrize("depth", [30, 1000, 3000, 20000])
def test_depth_has_no_bound(spark, tmp_path, depth):
    path = str(tmp_path / "deep")
    line = f'{{"id":"S","author_id":"u","comments":[{_chain(depth)}]}}'
    spark.createDataFrame([(line,)], "value string").write.text(path)
    flat = T.flatten_nested(T.read_threads(spark, path))
    parents = {r["id"]: r["parent_comment_id"] for r in flat.collect()}
    assert parents == {"S": None, "n0": "S", **{f"n{i}": f"n{i - 1}" for i in range(1, depth)}}
    assert [r["id"] for r in flat.orderBy("seq").limit(3).collect()] == ["S", "n0", "n1"]


def test_unparsed_lines_are_counted_not_lost(spark, tmp_path):
    path = str(tmp_path / "cut")
    good = json.dumps(_thread("S", "u", [_node("a")]))
    spark.createDataFrame([(good,), (good[:-20],), ("",), ("[1]",)], "value string").write.text(path)
    assert [r.id for r in T.read_threads(spark, path, skip_unparsed=True).collect()] == ["S"]
    assert T.unparsed_threads(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        T.read_threads(spark, path).collect()


def test_first_flair_depth_first(spark, tmp_path):
    path = str(tmp_path / "branch")
    first = {**_node("a", "v", [{**_node("b", "w"), "author_flair_text": "INTJ"}]), "author_flair_text": ""}
    last = {**_node("c", "w"), "author_flair_text": "ENFP"}
    _write(spark, path, [_thread("S", "u", [first, last])])
    items = T.flatten_nested(T.read_threads(spark, path)).withColumn("user_name", F.col("user_id"))
    users, _ = collect(items)
    assert {r["id"]: r["flair_text"] for r in users.collect()} == {"u": None, "v": "", "w": "INTJ"}


def test_collect_merges_into_tables(spark, tmp_path):
    path = str(tmp_path / "threads")
    _write(spark, path, [_thread("S", "u", [_node("a", "v", [_node("b", None)])])])
    items = T.flatten_nested(T.read_threads(spark, path))
    items = items.withColumn("user_name", F.concat(F.lit("name "), "user_id"))
    users, comments = collect(items)
    assert sorted(r["id"] for r in users.collect()) == ["u", "v"]
    assert sorted(r["id"] for r in comments.collect()) == ["S", "a"]
    report = {r["check"]: r["violations"] for r in B.check_integrity(comments, users).collect()}
    assert len(report) == 12 and set(report.values()) == {0}


def test_user_history(spark, rows):
    items = spark.createDataFrame(
        [(f"{k[0]}{i}", "u", k, i, "root", "p", "t") for k in ("submission", "comment") for i in range(5)],
        "id string, user_id string, kind string, hot_rank long, parent_submission_id string, parent_comment_id string, "
        "title string",
    )
    got = {r["id"]: (r["title"], r["parent_submission_id"], r["parent_comment_id"]) for r in B.user_history(items, 2).collect()}
    assert got == {"s0": ("t", "s0", None), "s1": ("t", "s1", None), "c0": (None, "root", None), "c1": (None, "root", None)}


def test_nulls_and_times(spark):
    df = spark.createDataFrame(
        [("", 0), ("<<NULL>>", 1612137600), (None, 1)], "submission_flair_text string, created_utc long"
    )
    assert [r[0] for r in B.normalise_nulls(df).select("submission_flair_text").collect()] == [None, "<<NULL>>", None]
    texts = df.select(B.format_created(F.col("created_utc")).alias("t"))
    assert [r["t"] for r in texts.collect()] == ["1970-01-01 00:00:00", "2021-02-01 00:00:00", "1970-01-01 00:00:01"]


def test_integrity_counts(spark):
    comments = spark.createDataFrame(
        [("a", "u", None, "x", 1, "s"), ("a", "u", None, "x", 1, "s"), ("b", "w", "gone", None, None, "s"), ("c", "w", "a", "x", 1, "s")],
        "id string, user_id string, parent_comment_id string, content string, upvotes long, subreddit string",
    ).withColumn("created_datetime", F.current_timestamp())
    users = spark.createDataFrame([("u", "n"), ("v", None)], "id string, name string")
    report = {r["check"]: r["violations"] for r in B.check_integrity(comments, users).collect()}
    assert {k: v for k, v in report.items() if v} == {
        "comments.content not null": 1,
        "comments.upvotes not null": 1,
        "users.name not null": 1,
        "comments.id unique": 1,
        "comments.user_id in users.id": 2,
        "comments.parent_comment_id in comments.id": 1,
    }


def test_people_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('type,posts\nINFP,"a ""q"", b|||second\nline|||"\nENTJ,plain\n', encoding="utf-8")
    got = tables.read_people(spark, str(path), multi_line=True).orderBy("person_id").collect()
    assert [(r["type"], r["posts"]) for r in got] == [("INFP", 'a "q", b|||second\nline|||'), ("ENTJ", "plain")]
    assert got[0]["person_id"] != got[1]["person_id"]

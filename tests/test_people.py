import random
import re

import pytest

from typelore.functions import patterns as P
from typelore.operators import groups as S
from typelore.operators import people as E

URL = r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,4}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)"
EMOJI = r"(:\w+:|<[/\]?3|\[()\\D*$][-^]?[:;=]|[:;=B8][-^]?[3DOPp@$*\\)(/|])(?=\s|[!.?]|$)"


def _people(spark, texts, kinds=None):
    kinds = kinds or ["INFP"] * len(texts)
    return spark.createDataFrame(
        [(i, k, t) for i, (k, t) in enumerate(zip(kinds, texts))], "person_id long, type string, posts string"
    )


def _counted(people):
    people = E.posts_without_urls(E.posts_count(E.split_posts(people)))
    return E.emojis_count(E.punctuations_count(E.urls_count(people)))


@pytest.mark.parametrize(
    "text, posts", [("a|||b|||", ["a", "b", ""]), ("", [""]), ("a", ["a"]), ("a||||b", ["a", "|b"]), (None, None)]
)
def test_split(spark, text, posts):
    row = E.posts_count(E.split_posts(_people(spark, [text]))).first()
    assert row["posts"] == posts
    assert row["posts_count"] == (None if posts is None else len(posts))


@pytest.mark.parametrize(
    "text, effective, documented",
    [
        (":)", 1, 1),
        (":smile:", 1, 1),
        (":smilé_2:", 1, 1),
        (":-P", 1, 1),
        ("8)", 1, 1),
        ("B8", 0, 0),
        ("):", 0, 1),
        ("<3", 0, 1),
        ("</3", 0, 1),
        ("<\\3", 0, 1),
        ("<3:", 1, 0),
        ("<D-;", 1, 0),
        (":) :( ;D", 3, 3),
        (":)x", 0, 0),
        (":)!", 1, 1),
        (":) :) ", 2, 2),
        ("well: yes", 0, 0),
        (":" + chr(0x1D400) + ":", 1, 1),
    ],
)
def test_emojis(spark, text, effective, documented):
    people = E.posts_without_urls(E.split_posts(_people(spark, [text])))
    assert E.emojis_count(people).first()["emojis_count"] == effective
    assert E.emojis_count(people, "documented").first()["emojis_count"] == documented
    assert len(re.findall(EMOJI, text)) == effective


@pytest.mark.parametrize(
    "text, left, urls",
    [
        ("see https://www.a-b.com/x?y=1&z ok", "see  ok", 1),
        ("http://ab.co/q! end", "! end", 1),
        ("at http://ab.co.", "at ", 1),
        ("http://ab.coé", "http://ab.coé", 0),
        ("http://a.b", "http://a.b", 0),
        ("https://xx.yz|http://ab.co", "|", 2),
    ],
)
def test_urls(spark, text, left, urls):
    row = E.urls_count(E.posts_without_urls(E.split_posts(_people(spark, [text])))).first()
    assert (row["posts_without_urls"], row["urls_count"]) == ([left], urls)
    assert re.sub(URL, "", text) == left


def test_counts_per_post_add_up(spark):
    """Counting in the joined text, and without building the array, gives the sum over posts."""
    rng = random.Random(7)
    bits = ["|||", "|", ":)", ":", "<", "3:", "http://ab.co/q", "https://", ".", "!", " ", "a", "é", "8)", "-", "\\", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    people = _people(spark, texts)
    by_array = {r["person_id"]: r for r in _counted(people).collect()}
    direct = {r["person_id"]: r for r in E.person_features(people).collect()}
    for i, text in enumerate(texts):
        posts = text.split("|||")
        plain = [re.sub(URL, "", p) for p in posts]
        expected = (
            len(posts),
            sum(len(re.findall(URL, p)) for p in posts),
            sum(len(re.findall(r"[.!?\\-]", p)) for p in plain),
            sum(len(re.findall(EMOJI, p)) for p in plain),
        )
        for row in (by_array[i], direct[i]):
            got = tuple(row[c] for c in ("posts_count", "urls_count", "punctuations_count", "emojis_count"))
            assert got == expected, text
        assert direct[i]["mean_emoji_count"] == pytest.approx(expected[3] / expected[0])
    means = E.count_means(_counted(people)).columns
    assert [c for c in means if c.startswith("mean_")] == [
        "mean_url_count",
        "mean_punctuation_count",
        "mean_emoji_count",
    ]


def test_flags(spark):
    row = E.dichotomies(_people(spark, ["x", "y"], ["ESTJ", "INFP"])).orderBy("person_id").collect()
    assert [tuple(r[f"is_{c}"] for c in "ESTJ") for r in row] == [(1, 1, 1, 1), (0, 0, 0, 0)]


def test_summary_is_one_scan_of_both_groupings(spark, rows):
    rng = random.Random(3)
    kinds = [rng.choice(["INFP", "INFP", "ESTJ", "ENTP", "ISFJ"]) for _ in range(200)]
    people = _people(spark, ["a. b! :)|||c"[: rng.randrange(1, 12)] for _ in kinds], kinds)
    features = E.person_features(people)
    both = S.group_stats(features).unionByName(S.dichotomy_stats(features))
    keep = lambda df: {r["group"]: tuple(r)[1:] for r in df.collect()}
    one, two = keep(S.summary(features)), keep(both)
    assert one.keys() == two.keys() and len(one) == 4 + 8
    for group, values in one.items():
        assert values == pytest.approx(two[group])
    assert all(one[a][0] + one[b][0] == 200 for _, a, b, _ in P.DICHOTOMIES)
    e_people = [k for k in kinds if k[0] == "E"]
    assert one["E"][0] == len(e_people)
    ranked = S.rank_groups(S.summary(features), "mean_emoji_count").collect()
    assert [r[1] for r in ranked] == sorted(r[1] for r in ranked)


def test_group_content_in_order(spark):
    people = _people(spark, ["b|||a", "c"], ["INFP", "INTP"])
    content = S.group_content(people).filter("group = 'I'").orderBy("person_id", "post_no")
    assert " ".join(r["post"] for r in content.collect()) == "b a c"


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert [tuple(r) for r in E.profile(df).collect()] == [("a", 2, "bigint"), ("b", 1, "string")]


def test_type_counts(spark):
    got = E.type_counts(_people(spark, ["x"] * 4, ["INFP", "ESTJ", "INFP", None])).collect()
    assert [tuple(r) for r in got] == [("INFP", 2), ("ESTJ", 1)]

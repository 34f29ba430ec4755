import pytest
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.functions.text import tidy_comment, unbold
from typelore.operators import declarations as C
from typelore.plans import type_resolution

BOLD_INFP = "".join(chr(0x1D400 + ord(c) - ord("A")) for c in "INFP")


@pytest.mark.parametrize(
    "flair, expected",
    [
        (f"{BOLD_INFP} fan", "INFP"),
        ("infp", "INFP"),
        ("INTJ/ENFP", "INTJ"),
        ("INXP", "INXP"),
        ("xxxx", "XXXX"),
        ("no type", None),
        ("", None),
        (None, None),
    ],
)
def test_flair_type(spark, flair, expected):
    df = spark.createDataFrame([(flair,)], "flair string")
    assert df.select(C.flair_type(F.col("flair"))).first()[0] == expected


def test_unbold_changes_bold_capitals_only(spark):
    text = "a" + chr(0x1D400) + chr(0x1D419) + chr(0x1D41A) + chr(0x1D3FF) + "é"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unbold(F.col("t"))).first()[0] == "aAZ" + chr(0x1D41A) + chr(0x1D3FF) + "é"


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("I'm an ENTJ", "i_am_mbti_regex"),
        ("well, I am INFP too", "i_am_mbti_regex"),
        ("my ISTJ experience", "my_mbti_regex"),
        ("My ISTJ personality", "my_mbti_regex"),
        ("ESFP (m) here", "mbti_here_regex"),
        ("ESFP here", "mbti_here_regex"),
        ("fellow INTP", "fellow_mbti_regex"),
        ("I(ENFJ)", "i_mbti_regex"),
        ("Me (ENFJ)", "i_mbti_regex"),
        ("ISFP looking for", "looking_for_regex"),
    ],
)
def test_each_declaration(spark, text, pattern):
    df = spark.createDataFrame([("c", text, text)], "id string, title string, content string")
    found = C.extract_all(df).first().asDict()
    code = next(w for w in ("ENTJ", "INFP", "ISTJ", "ESFP", "INTP", "ENFJ", "ISFP") if w in text)
    assert {c: v for c, v in found.items() if v and c != "id"} == {
        f"{pattern}__on__title": code,
        f"{pattern}__on__content": code,
    }
    assert tuple(C.extract_declarations(df, pattern).first()) == ("c", code, code)


@pytest.mark.parametrize("text", ["i am infp", "I was INFP", "I am a n INFP", "their ISTJ experience", None, ""])
def test_no_declaration(spark, text):
    df = spark.createDataFrame([("c", text, text)], "id string, title string, content string")
    assert C.with_extracted_type(df).first()["extracted_mbti"] is None
    assert C.last_match(C.extract_all(df)).first()["extracted_mbti"] is None


def test_last_match_follows_column_order(spark):
    df = spark.createDataFrame(
        [("a", "I am INFP", "ENTJ looking for"), ("b", "ENTJ looking for", "I am INFP")],
        "id string, title string, content string",
    )
    expected = [("a", "ENTJ"), ("b", "ENTJ")]
    assert [tuple(r) for r in C.last_match(C.extract_all(df)).orderBy("id").collect()] == expected
    direct = C.with_extracted_type(df).select("id", "extracted_mbti").orderBy("id")
    assert [tuple(r) for r in direct.collect()] == expected
    assert C.rows_with_k_matches(C.extract_all(df), 2).count() == 2
    counts = {r["pattern"]: r["matches"] for r in C.match_counts(C.extract_all(df)).collect()}
    assert counts["looking_for_regex__on__title"] == 1 and sum(counts.values()) == 4
    assert list(counts) == list(C.MATCH_COLUMNS) and len(counts) == 2 * len(P.DECLARATIONS)


def test_resolution(spark):
    comments = spark.createDataFrame(
        [
            ("1", "a", None, "I am INFP"),
            ("2", "a", None, "fellow INFP"),
            ("3", "b", None, "I am INFP"),
            ("4", "b", None, "I am ENTJ"),
            ("5", "c", None, "I am ISTJ"),
            ("6", "d", None, "hello"),
        ],
        "id string, user_id string, title string, content string",
    )
    users = spark.createDataFrame(
        [("a", "A", None), ("b", "B", ""), ("c", "C", "esfp"), ("d", "D", None)],
        "id string, name string, flair_text string",
    )
    typed = C.with_extracted_type(comments)
    assert {r["user_id"]: r["types"] for r in C.types_per_user(typed).collect()} == {
        "a": ["INFP"],
        "b": ["ENTJ", "INFP"],
        "c": ["ISTJ"],
    }
    assert [r["user_id"] for r in C.ambiguous_users(typed).collect()] == ["b"]
    resolved = type_resolution.users_with_type(comments, users)
    assert {r["id"]: (r["mbti_type_from_flair_text"], r["mbti_type_from_comments"], r["mbti_type"]) for r in resolved.collect()} == {
        "a": (None, "INFP", "INFP"),
        "b": (None, None, None),
        "c": ("ESFP", "ISTJ", "ESFP"),
        "d": (None, None, None),
    }
    assert [tuple(r) for r in type_resolution.type_counts(comments, users).collect()] == [("ESFP", 1), ("INFP", 1)]
    joined = C.comments_with_user_type(typed, C.type_from_flair(users))
    assert {"id_x", "id_y"} <= set(joined.columns) and joined.count() == 6


def test_search_is_planned_once(spark):
    """No filter on a found type is moved in front of the search."""
    df = spark.createDataFrame([("1", "a", "t", "c")], "id string, user_id string, title string, content string")
    plan = C.unambiguous_type(C.with_extracted_type(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("looking for") == 2  # title and content


@pytest.mark.parametrize(
    "text, expected",
    [
        ("> quoted\nanswer bc of it", "answer because of it"),
        ("see [View Poll](https://www.a.com/p) or [View Poll] now", "see  or  now"),
        ("at https://www.a-b.com/x?y=1 bc, abc", "at  because, abc"),
        ("a > b", "a > b"),
    ],
)
def test_tidy_comment(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tidy_comment(F.col("t"))).first()[0] == expected


def test_tidy_comment_with_other_abbreviations(spark):
    df = spark.createDataFrame([("w/o tbh $",)], "t string")
    done = df.select(tidy_comment(F.col("t"), {"w/o": "without", "tbh": "to be $1"}))
    assert done.first()[0] == "without to be $1 $"

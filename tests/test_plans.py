"""What the optimizer makes of the jobs."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from typelore.operators import cleaning as G
from typelore.operators import declarations as C
from typelore.operators import ingest as B
from typelore.operators import people as E
from typelore.operators import vocabulary as W
from typelore import session
from typelore.operators import groups as S
from typelore.plans import registry, type_resolution
from typelore.plans.registry import QUERIES
from typelore.sources import tables
from tests.test_people import _people


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stored")
    comments = spark.createDataFrame(
        [("c", "u", None, None, "t", "I am INFP", 0, 1, "s", None)],
        "id string, user_id string, parent_submission_id string, parent_comment_id string, title string, content string, "
        "created_utc long, upvotes long, subreddit string, submission_flair_text string",
    )
    B.with_created_datetime(comments).write.parquet(str(path / "comments"))
    spark.createDataFrame([("u", "n", None)], "id string, name string, flair_text string").write.parquet(str(path / "users"))
    _people(spark, ["a|||b"]).write.parquet(str(path / "people"))
    return path


def test_filter_and_columns_reach_the_scan(spark, stored):
    plan = _plan(C.lookup(tables.read_comments(spark, str(stored / "comments")), "c").select("id", "content"))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,c)]" in plan
    assert "ReadSchema: struct<id:string,content:string>" in plan


def test_type_resolution_reads_three_columns_of_comments(spark, stored):
    comments = tables.read_comments(spark, str(stored / "comments"))
    plan = _plan(type_resolution.type_counts(comments, tables.read_users(spark, str(stored / "users"))))
    assert "ReadSchema: struct<user_id:string,title:string,content:string>" in plan
    assert "ReadSchema: struct<id:string,flair_text:string>" in plan


def test_tokens_need_no_shuffle_and_clean_once(spark, stored):
    people = spark.read.parquet(str(stored / "people"))
    plan = _plan(G.token_table(people))
    assert "Exchange" not in plan and "Python" not in plan
    simple = io.StringIO()
    with redirect_stdout(simple):
        G.token_table(people).explain()
    assert simple.getvalue().count("https?://") == 1


def test_features_need_no_shuffle(spark, stored):
    plan = _plan(E.person_features(spark.read.parquet(str(stored / "people"))))
    assert "Exchange" not in plan and "Generate" not in plan


def test_counts_are_combined_before_the_shuffle(spark, stored):
    plan = _plan(W.word_occurrences(G.token_table(spark.read.parquet(str(stored / "people")))))
    assert plan.count("Exchange") >= 1 and "partial_count" in plan


def test_top_n_cuts_before_the_shuffle_and_broadcasts_the_plan(spark):
    forum = F.when(F.col("id") % 3 == 0, "mbti").otherwise("infj")
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), forum.alias("subreddit"), F.col("id").alias("hot_rank")
    )
    plan = _plan(B.hot_top_n(df))
    assert plan.count("WindowGroupLimit") >= 4 and "LocalTableScan" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


HOT = ("remove_rare_words", "lemmatize", "comments_with_user_type", "label_vectors", "plot_table")


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_can_be_split(spark, name):
    """Joins with a hot key get both sides straight from a shuffle, or carry a salt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        joins = []

        def walk(node):
            if node.nodeName().startswith("SortMergeJoin"):
                joins.append(node)
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
        key = {"remove_rare_words": "token", "lemmatize": "token"}.get(name, "user_id")
        hot = [j for j in joins if key in j.leftKeys().toString() or "_salt" in j.leftKeys().toString()]
        assert hot
        for join in hot:
            below = [join.children().apply(i) for i in range(2)]
            while any(n.nodeName().startswith(("Sort", "InputAdapter", "WholeStage")) for n in below):
                below = [
                    n.children().apply(0) if n.nodeName().startswith(("Sort", "InputAdapter", "WholeStage")) else n
                    for n in below
                ]
            assert all(n.nodeName() == "Exchange" for n in below) or "_salt" in join.leftKeys().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_letters_need_one_scan(spark, stored):
    features = E.person_features(spark.read.parquet(str(stored / "people")))
    out = io.StringIO()
    with redirect_stdout(out):
        S.dichotomy_stats(features).explain()
    assert out.getvalue().count("FileScan") == 1


def test_scratch_is_removed_and_needs_a_shared_folder(spark, tmp_path):
    import os

    with session.scratch(spark) as folder:
        assert session.cut_lineage(spark.range(3), "x").count() == 3
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Cluster)


@pytest.mark.parametrize(
    "name", ["df_idf", "term_group_correlation", "top_terms", "stats_and_tokens_per_person", "word_occurrences"]
)
def test_texts_are_cleaned_once_for_lemmas_and_counts(spark, tmp_path, monkeypatch, name):
    docs = [(1, "cats and dogs\nthe dog"), (2, "a cat sees mice"), (2, "dogs dogs"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written = []

    def recorded(df, label):
        written.append(_plan(df))
        return session.cut_lineage(df, label)

    monkeypatch.setattr(registry, "cut_lineage", recorded)
    result = QUERIES[name](spark, str(tmp_path))
    assert result.count() > 0
    assert sum("regexp_extract_all" in plan for plan in [*written, _plan(result)]) == 1

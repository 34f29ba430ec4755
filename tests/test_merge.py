import random

import pytest
from pyspark.sql import functions as F

from typelore.operators import merge as M
from typelore.streaming import merge as stream

USER_SCHEMA = "id string, name string, flair_text string, seq long"
COMMENT_SCHEMA = (
    "id string, user_id string, parent_submission_id string, parent_comment_id string, title string, content string, "
    "created_datetime timestamp, upvotes long, subreddit string, submission_flair_text string, seq long"
)


@pytest.mark.parametrize(
    "flairs, stored",
    [
        ([None, None], None),
        (["", None], None),
        ([None, ""], ""),
        ([None, "", "INFP", "ENTJ"], "INFP"),
        (["INTJ", "ENFP"], "INTJ"),
        (["INTJ", None, ""], "INTJ"),
    ],
)
def test_flair_sequences(spark, flairs, stored):
    updates = spark.createDataFrame([("u", f"n{i}", f, i) for i, f in enumerate(flairs)], USER_SCHEMA)
    assert tuple(M.merge_users(None, updates).first()) == ("u", "n0", stored)
    state = None
    for i in range(len(flairs)):
        state = M.merge_users(state, updates.filter(F.col("seq") == i), keep_state=True)
    assert state.select(*M.USER_COLUMNS).first()["flair_text"] == stored


def _user_updates(n, seed):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(40)}", f"n{rng.randrange(9)}", rng.choice([None, "", "a", "b"]), i) for i in range(n)]


def _upsert_users(updates):
    table = {}
    for uid, name, flair, _ in updates:
        if uid not in table:
            table[uid] = (uid, name, flair)
        elif table[uid][2] in (None, ""):
            table[uid] = (uid, table[uid][1], flair)
    return sorted(table.values(), key=repr)


def _comment_updates(n, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    from datetime import datetime

    return [
        (f"c{rng.randrange(40)}", pick("u1", "u2"), pick("s1", None), pick(None, "p1", "p2"), pick(None, "t"), pick("x", "y"),
         datetime(2021, 1, 1 + rng.randrange(20)), rng.randrange(9), pick("r1", "r2"), pick(None, "f"), i)
        for i in range(n)
    ]


def _upsert_comments(updates, keep_parent=False):
    table = {}
    for row in updates:
        cid, user, root, parent, title, content, created, up, sub, flair, _ = row
        if cid in table:
            old = table[cid]
            user, root, sub, flair = old[1], old[2], old[8], old[9]
            if keep_parent and parent is None:
                parent = old[3]
        table[cid] = (cid, user, root, parent, title, content, created, up, sub, flair)
    return sorted(table.values(), key=repr)


def test_users_as_row_by_row_upsert(spark, rows):
    updates = _user_updates(600, 1)
    df = spark.createDataFrame(updates, USER_SCHEMA)
    assert rows(M.merge_users(None, df.repartition(7))) == _upsert_users(updates)


@pytest.mark.parametrize("keep_parent", [False, True])
def test_comments_as_row_by_row_upsert(spark, rows, keep_parent):
    updates = _comment_updates(600, 2)
    df = spark.createDataFrame(updates, COMMENT_SCHEMA).repartition(7)
    assert rows(M.merge_comments(None, df, keep_parent)) == _upsert_comments(updates, keep_parent)
    # in three parts, merged one after the other
    state = None
    for low in (0, 150, 400):
        high = {0: 150, 150: 400, 400: 600}[low]
        part = df.filter((F.col("seq") >= low) & (F.col("seq") < high))
        state = M.merge_comments(state, part, keep_parent, keep_state=True)
    assert rows(state.select(*M.COMMENT_COLUMNS)) == _upsert_comments(updates, keep_parent)


def test_states_merge_in_any_grouping(spark, rows):
    updates = _user_updates(300, 3)
    df = spark.createDataFrame(updates, USER_SCHEMA)
    a, b, c = (M.user_state(df.filter(F.col("seq") % 3 == i)) for i in range(3))
    left = M.merge_user_states(M.merge_user_states(a, b), c)
    right = M.merge_user_states(c, M.merge_user_states(b, a))
    assert rows(left) == rows(right) == rows(M.merge_user_states(M.user_state(df)))


def test_stream_equals_batch_and_survives_replay(spark, rows, tmp_path):
    updates = _user_updates(300, 4)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        part = [u for u in updates if i * 100 <= u[3] < (i + 1) * 100]
        spark.createDataFrame(part, USER_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream.stream_merge_users(
            spark.readStream.schema(USER_SCHEMA).parquet(source), target, str(tmp_path / "state")
        ).awaitTermination()
    expected = _upsert_users(updates)
    assert rows(stream.read_merged_users(spark, target)) == expected
    # the second batch once more, as after a crash between its write and its commit
    again = spark.createDataFrame([u for u in updates if 100 <= u[3] < 200], USER_SCHEMA)
    stream._append_merged(target, lambda b: M.merge_user_states(M.user_state(b)))(again, 1)
    assert rows(stream.read_merged_users(spark, target)) == expected


def test_compaction_keeps_the_table_and_ignores_replays(spark, rows, tmp_path):
    updates, target = _user_updates(300, 6), str(tmp_path / "out")
    write = stream._append_merged(target, lambda b: M.merge_user_states(M.user_state(b)))
    assert stream.compact_users(spark, target) == -1
    for i in range(5):
        write(spark.createDataFrame(updates[i * 60 : (i + 1) * 60], USER_SCHEMA), i)
        if i == 1:
            assert stream.compact_users(spark, target) == 1
            write(spark.createDataFrame(updates[60:120], USER_SCHEMA), 1)
    expected = _upsert_users(updates)
    assert rows(stream.read_merged_users(spark, target)) == expected
    assert stream.compact_users(spark, target) == 4 == stream.compact_users(spark, target)
    assert len(stream._states(spark, target)[0]) == 1
    assert rows(stream.read_merged_users(spark, target)) == expected


def test_comment_stream(spark, rows, tmp_path):
    updates = _comment_updates(200, 5)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        part = [u for u in updates if i * 100 <= u[-1] < (i + 1) * 100]
        # positions start again in every delivery
        part = [(*u[:-1], u[-1] % 100) for u in part]
        spark.createDataFrame(part, COMMENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream.stream_merge_comments(
            spark.readStream.schema(COMMENT_SCHEMA).parquet(source), target, str(tmp_path / "state")
        ).awaitTermination()
    assert rows(stream.read_merged_comments(spark, target)) == _upsert_comments(updates)
    assert rows(stream.read_merged_comments(spark, target, keep_parent=True)) == _upsert_comments(updates, True)

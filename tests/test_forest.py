import json
import random

import pytest

from typelore.operators.forest import flatten_edges
from typelore.session import scratch
from typelore.sources import threads as T

EDGES = "thread string, id string, parent_id string, pos long, kind string, user_id string"


def _edges(threads):
    """The edge table of nested threads: one row per submission, comment and "more" node, place among siblings."""
    out = []
    for t in threads:
        out.append((t["id"], t["id"], None, 0, None, t.get("author_id")))
        open_ = [(t["id"], i, c) for i, c in enumerate(t.get("comments") or [])]
        while open_:
            parent, pos, node = open_.pop()
            out.append((t["id"], node["id"], parent, pos, node.get("kind"), node.get("author_id")))
            open_ += [(node["id"], i, c) for i, c in enumerate(node.get("replies") or [])]
    return out


def _random_tree(rng, tid, n):
    nodes = [{"id": f"{tid}c{i}", "author_id": rng.choice(["u", "v", None]), "replies": []} for i in range(n)]
    for node in nodes:
        if rng.random() < 0.25:
            node["kind"] = "more"
    top = []
    for i, node in enumerate(nodes):
        holder = top if i == 0 or rng.random() < 0.2 else nodes[rng.randrange(i)]["replies"]
        holder.append(node)
    return {"id": tid, "author_id": rng.choice(["u", None]), "comments": top}


def _flat(spark, edges):
    with scratch(spark):
        return {(r["thread"], r["id"]): (r["parent_comment_id"], r["at"]) for r in flatten_edges(edges).collect()}


def test_same_rows_and_order_as_nested(spark, tmp_path):
    rng = random.Random(7)
    more = {"id": "m1", "kind": "more", "replies": [{"id": "m2", "kind": "more", "replies": [{"id": "g", "author_id": "u"}]},
                                                      {"id": "h", "author_id": "u"}]}
    threads = [
        {"id": "S", "author_id": "u", "comments": [{"id": "a", "author_id": "u", "replies": [{"id": "b", "replies": [
            {"id": "c", "author_id": "u"}]}]}, {"id": "e", "author_id": "u", "replies": [more]}]},
        {"id": "N", "comments": [{"id": "f", "author_id": "u"}, more]},
        {"id": "Z", "author_id": "u", "comments": []},
        *(_random_tree(rng, f"R{k}", rng.randrange(1, 60)) for k in range(12)),
    ]
    path = str(tmp_path / "threads")
    spark.createDataFrame([(json.dumps(t),) for t in threads], "value string").write.text(path)
    nested = {
        (r["parent_submission_id"], r["id"]): (r["parent_comment_id"], r["seq"]["at"])
        for r in T.flatten_nested(T.read_threads(spark, path)).collect()
    }
    found = _flat(spark, spark.createDataFrame(_edges(threads), EDGES).repartition(5))
    assert found == nested
    assert found[("N", "g")] == (None, 2) and found[("S", "g")] == ("e", 5)


def test_chains_of_3000(spark):
    depth = 3000
    chain = [("S", "S", None, 0, None, "u")]
    chain += [("S", f"n{i}", "S" if i == 0 else f"n{i - 1}", 0, "more" if i % 3 == 1 else None, "u") for i in range(depth)]
    runs = [("M", "M", None, 0, None, "u"), ("M", "top", "M", 0, None, "u")]
    runs += [("M", f"m{i}", "top" if i == 0 else f"m{i - 1}", 0, "more", None) for i in range(depth)]
    runs += [("M", "leaf", f"m{depth - 1}", 0, None, "u")]
    found = _flat(spark, spark.createDataFrame(chain + runs, EDGES).repartition(8))
    numbered = [i for i in range(depth) if i % 3 != 1]
    expected = {("S", "S"): (None, 0), ("M", "M"): (None, 0), ("M", "top"): ("M", 1), ("M", "leaf"): ("top", 2)}
    for at, i in enumerate(numbered, start=1):
        before = "S" if i == 0 else f"n{i - 1 if (i - 1) % 3 != 1 else i - 2}"
        expected[("S", f"n{i}")] = (before, at)
    assert found == expected


def test_defined_cases(spark):
    rows = [
        ("S", "S", None, 0, None, "u"),
        ("S", "a", "S", 0, None, "u"),
        ("S", "a", "S", 0, None, "u"),  # repeated row: once
        (None, "x", "S", 1, None, "u"),  # no thread: left out
        ("S", None, "S", 1, None, "u"),  # no id: left out
        ("S", "o", "gone", 0, None, "u"),  # parent not in the thread
        ("S", "o1", "o", 0, None, "u"),
        ("S", "p", "q", 0, None, "u"),  # a cycle
        ("S", "q", "p", 0, None, "u"),
        ("S", "b", "a", 0, None, "u"),  # two replies of a in one place
        ("S", "c", "a", 0, None, "u"),
        ("S", "d", "c", 0, None, "u"),
        ("S", "e", "S", 1, "more", None),  # the last top place: a "more" node without replies
        ("S", "f", None, 0, None, "u"),  # a second root
    ]
    found = _flat(spark, spark.createDataFrame(rows, EDGES))
    assert found == {
        ("S", "S"): (None, 0),
        ("S", "a"): ("S", 1),
        ("S", "o"): (None, None),
        ("S", "o1"): ("o", None),
        ("S", "p"): ("q", None),
        ("S", "q"): ("p", None),
        ("S", "b"): ("a", None),
        ("S", "c"): ("a", None),
        ("S", "d"): ("c", None),
        ("S", "f"): (None, None),
    }
    assert _flat(spark, spark.createDataFrame([], EDGES)) == {}


def test_columns_carried_and_clashes(spark):
    edges = spark.createDataFrame([("S", "S", None, 0, None, "u", "x")], EDGES + ", content string")
    with scratch(spark):
        got = flatten_edges(edges)
        assert got.columns == ["thread", "id", "user_id", "content", "parent_comment_id", "at"]
        assert got.collect()[0]["content"] == "x"
    with pytest.raises(ValueError):
        flatten_edges(edges.withColumnRenamed("content", "at"))

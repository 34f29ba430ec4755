"""Edge tables of comment forests, flattened as the nested form is: "more" nodes transparent, depth-first order.

The work is a few joins on unique keys per round, over a logarithmic number of rounds: pointer jumping lets every node
skip its chain of "more" ancestors, and list ranking over an Euler tour numbers the nodes depth first. No parent's
children meet in one task, so a submission that holds most comments costs what any other does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typelore.session import cut_lineage

EDGE_COLUMNS = ("thread", "id", "parent_id", "pos", "kind", "user_id")


def _rounds(n: int) -> int:
    """Rounds of pointer doubling after which every path of at most ``n`` steps has ended."""
    return max(1, math.ceil(math.log2(max(n, 2)))) + 1


def _skip_more(nodes: DataFrame) -> DataFrame:
    """(thread, id, up): the nearest ancestor of each node that is no "more" node, NULL where there is none.

    Only "more" nodes point on; a chain of ``c`` of them is skipped in ``log2(c)`` rounds. A cycle of "more" nodes
    ends nowhere: after the bound its members point to NULL.
    """
    more = nodes.filter("more").select("thread", F.col("id").alias("m"), F.col("parent_id").alias("ptr"))
    kind = nodes.select("thread", F.col("id").alias("ptr"), F.col("more").alias("ptr_more"))
    state = more.join(kind, ["thread", "ptr"], "left").select(
        "thread", "m", "ptr", F.coalesce("ptr_more", F.lit(False)).alias("open")
    )
    n = state.count()
    for step in range(_rounds(n)):
        state = cut_lineage(state, f"more-{step}")
        if state.filter("open").limit(1).count() == 0:
            break
        hop = state.select("thread", F.col("m").alias("ptr"), F.col("ptr").alias("next"), F.col("open").alias("next_open"))
        state = state.join(hop, ["thread", "ptr"], "left").select(
            "thread", "m",
            F.when(F.col("open"), F.col("next")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(F.col("open"), F.coalesce("next_open", F.lit(False))).otherwise(F.lit(False)).alias("open"),
        )
    state = state.select("thread", "m", F.when(~F.col("open"), F.col("ptr")).alias("ptr"), F.lit(True).alias("via"))
    jumps = nodes.join(state.withColumnRenamed("m", "parent_id"), ["thread", "parent_id"], "left")
    return jumps.select("thread", "id", F.when(F.col("via"), F.col("ptr")).otherwise(F.col("parent_id")).alias("up"))


def _tour(nodes: DataFrame) -> DataFrame:
    """Elements (thread, e, succ, w) of the Euler tour: ``D`` on entering a node, ``U`` on leaving it.

    Children are taken by ``pos``; ``w`` is 1 on entering a node that is a row (no "more" node, no submission).
    """
    child = nodes.filter(F.col("parent_id").isNotNull()).select(
        "thread", F.col("parent_id").alias("p"), F.col("pos").alias("at"), F.col("id").alias("c")
    )
    places = child.groupBy("thread", "p", "at").agg(F.count(F.lit(1)).alias("k"))
    whole = (
        places.groupBy("thread", "p")
        .agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.min("at").alias("lo"), F.max("at").alias("hi"),
             F.max(F.col("at").isNull().cast("int")).alias("gap"))
        .filter("gap = 0 AND most = 1 AND lo = 0 AND hi = k - 1")
        .select("thread", "p")
    )
    child = child.join(whole, ["thread", "p"])
    placed = child.select("thread", F.col("c").alias("id"), F.lit(True).alias("placed"))
    first = child.filter("at = 0").select("thread", F.col("p").alias("id"), F.col("c").alias("first"))
    after = child.select("thread", "p", (F.col("at") - 1).alias("pos"), F.col("c").alias("next"))
    linked = (
        nodes.join(first, ["thread", "id"], "left")
        .join(placed, ["thread", "id"], "left")
        .join(after.withColumnRenamed("p", "parent_id"), ["thread", "parent_id", "pos"], "left")
    )
    down = linked.select(
        "thread", F.struct(F.col("id"), F.lit(0).alias("u")).alias("e"),
        F.when(F.col("first").isNotNull(), F.struct(F.col("first").alias("id"), F.lit(0).alias("u")))
        .otherwise(F.struct(F.col("id"), F.lit(1).alias("u"))).alias("succ"),
        F.when(F.col("more") | F.col("parent_id").isNull(), 0).otherwise(1).alias("w"),
    )
    up = linked.select(
        "thread", F.struct(F.col("id"), F.lit(1).alias("u")).alias("e"),
        F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("id"), F.lit(0).alias("u")))
        .when(F.col("placed"), F.struct(F.col("parent_id").alias("id"), F.lit(1).alias("u")))
        .alias("succ"),
        F.lit(0).alias("w"),
    )
    return down.unionByName(up)


def _rank(tour: DataFrame) -> DataFrame:
    """(thread, e, s, tail): weights from ``e`` to the end of its list along ``succ``, and that end, by pointer jumping.

    Given the tour with its links reversed, ``s`` counts from the head up to ``e`` and ``tail`` is the head.

    A list that has not ended after the bound is a cycle; its elements get ``tail`` NULL.
    """
    state = tour.select("thread", "e", "succ", F.col("w").cast("long").alias("s"), F.col("e").alias("tail"))
    n = state.count()
    for step in range(_rounds(n)):
        state = cut_lineage(state, f"tour-{step}")
        if state.filter(F.col("succ").isNotNull()).limit(1).count() == 0:
            break
        hop = state.select(
            "thread", F.col("e").alias("succ"), F.col("succ").alias("next"), F.col("s").alias("s_next"),
            F.col("tail").alias("tail_next"),
        )
        joined = state.join(hop, ["thread", "succ"], "left")
        open_ = F.col("succ").isNotNull()
        state = joined.select(
            "thread", "e",
            F.when(open_, F.col("next")).alias("succ"),
            (F.col("s") + F.when(open_, F.coalesce("s_next", F.lit(0))).otherwise(0)).alias("s"),
            F.when(open_ & F.col("tail_next").isNotNull(), F.col("tail_next")).otherwise(F.col("tail")).alias("tail"),
        )
    return state.select("thread", "e", "s", F.when(F.col("succ").isNull(), F.col("tail")).alias("tail"))


def flatten_edges(edges: DataFrame) -> DataFrame:
    """One row per submission and comment of an edge table, as ``flatten_nested`` gives it from the nested form.

    ``edges`` holds ``thread`` (the submission's id), ``id``, ``parent_id`` (NULL for the submission, the submission's
    id for a top comment), ``pos`` (0-based place among the parent's replies), ``kind`` ("more" for a node that stands
    for further replies of its parent) and ``user_id``; further columns are carried along. Returned: every row that is no
    "more" node, without ``parent_id``, ``pos`` and ``kind``, with ``parent_comment_id`` (the nearest ancestor that is
    no "more" node, if it has an author; else NULL; NULL for the submission) and ``at`` (long: 0 for the submission,
    then 1, 2, ... depth first, children by ``pos``, "more" nodes unnumbered but their replies in their place).

    Defined cases: rows with NULL ``thread`` or ``id`` are left out; repeated rows count once (one of them is kept).
    A node whose parent is not in its thread, with all below it, nodes on a cycle, and a row with NULL ``parent_id``
    other than the submission keep their rows with ``at`` NULL and the parent rule above. Where the replies of one
    parent do not hold the places 0 to k-1 once each (a NULL, repeated or missing ``pos``), they and all below them
    get ``at`` NULL; the parent keeps its number. Empty input gives empty output.
    """
    carried = [c for c in edges.columns if c not in EDGE_COLUMNS]
    clash = {"more", "at", "parent_comment_id", "_up", "_authored", "_s", "_head"} & set(carried)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are names this operator gives")
    nodes = (
        edges.filter(F.col("thread").isNotNull() & F.col("id").isNotNull())
        .dropDuplicates(["thread", "id"])
        .withColumn("more", F.coalesce(F.col("kind") == "more", F.lit(False)))
    )
    nodes = cut_lineage(nodes, "forest-nodes")
    core = nodes.select("thread", "id", "parent_id", "pos", "more", "user_id")
    up = _skip_more(core).withColumnRenamed("up", "_up")
    tour = _tour(core)
    back = tour.filter(F.col("succ").isNotNull()).select("thread", F.col("succ").alias("e"), F.col("e").alias("pred"))
    ranked = _rank(tour.join(back, ["thread", "e"], "left").select("thread", "e", F.col("pred").alias("succ"), "w"))
    entered = ranked.filter(F.col("e.u") == 0).select(
        "thread", F.col("e.id").alias("id"), F.col("s").alias("_s"), F.col("tail").alias("_head")
    )
    authored = core.select("thread", F.col("id").alias("_up"), F.col("user_id").isNotNull().alias("_authored"))
    rows = (
        nodes.filter(~F.col("more"))
        .join(up, ["thread", "id"], "left")
        .join(authored, ["thread", "_up"], "left")
        .join(entered, ["thread", "id"], "left")
    )
    from_root = (F.col("_head.id") == F.col("thread")) & (F.col("_head.u") == 0)
    at = F.when(F.col("parent_id").isNull(), F.when(F.col("id") == F.col("thread"), F.lit(0).cast("long"))).when(
        from_root, F.col("_s")
    )
    parent = F.when(F.col("parent_id").isNotNull() & F.coalesce("_authored", F.lit(False)), F.col("_up"))
    return rows.select("thread", "id", "user_id", *carried, parent.alias("parent_comment_id"), at.alias("at"))

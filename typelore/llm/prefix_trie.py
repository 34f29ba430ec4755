"""Prefix trie of conversations by fixed-length block digests, refined turn by turn only where siblings part.

Every prefix of a conversation has a digest: two sums, modulo nothing, of 42-bit hashes of (position, role, text) over
its turns, computed as running sums in one window per conversation. Conversations are grouped first at block ends
(every ``BLOCK`` turns, and at their own end). A block whose members all reach the same next block end has one node
at each depth inside it, with the members of that end: those nodes are derived, not grouped. Only inside blocks where
members part are the turns grouped one by one. Subtree sums use the smallest member of each node: a node lies below
another exactly when its smallest member belongs to it and it is at least as deep, so they are suffix sums per
conversation, summed per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typelore.session import cut_lineage

#: Turns per block.
BLOCK = 8
#: Bits of each of the two turn hashes that are summed (sums stay below 2**63 for 2**21 turns).
BITS = 42
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, d, role, text) for d = 1.. of each rebuilt conversation, and (c, length) of all, turnless ones included.

    Turns are ordered by turn (null first), then role and text; null role or text is empty; rows with a null conv_id
    are left out. Conversation c takes the first h = crc32(c) % 9 turns of c - c % 5, then its own after its first h.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.withColumn("p", F.row_number().over(order)).drop("turn")
    lengths = turns.groupBy("c").agg(F.max("p").alias("n"))
    convs = lengths.select("c", "n", (F.crc32(F.col("c").cast("string")) % 9).alias("h"), (F.col("c") - F.col("c") % 5).alias("b"))
    bases = lengths.select(F.col("c").alias("b"), F.col("n").alias("nb"))
    convs = convs.join(bases, "b", "left").withColumn("k", F.least("h", F.coalesce("nb", F.lit(0))))
    head = turns.filter(F.col("p") <= 8).select(F.col("c").alias("b"), "p", "role", "text")
    first = convs.select("c", "b", "k").join(head, "b").filter(F.col("p") <= F.col("k")).select("c", F.col("p").alias("d"), "role", "text")
    own = turns.join(convs.select("c", "h", "k"), "c").filter(F.col("p") > F.col("h"))
    rest = own.select("c", (F.col("k") + F.col("p") - F.col("h")).alias("d"), "role", "text")
    sizes = convs.select("c", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    return first.unionByName(rest), sizes


def _digests(turns: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Per conversation and depth (0 = root): prefix digest, digests before and after, block start's digest, bytes."""
    mask = (1 << BITS) - 1
    hashed = turns.select(
        "c", "d", F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64("d", "role", "text").bitwiseAND(F.lit(mask)).alias("g1"),
        F.xxhash64(F.lit("second"), "text", "role", "d").bitwiseAND(F.lit(mask)).alias("g2"),
    )
    root = sizes.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"))
    rows = hashed.unionByName(root).join(sizes, "c")
    by_depth = Window.partitionBy("c").orderBy("d")
    upto = by_depth.rowsBetween(Window.unboundedPreceding, 0)
    before = by_depth.rowsBetween(Window.unboundedPreceding, -1)
    boundary = (F.col("d") % block == 0) | (F.col("d") == F.col("length"))
    start = F.col("d") % block == 0
    digest = F.struct(F.col("d").alias("d"), *[F.sum(g).over(upto).alias(p) for g, p in (("g1", "p1"), ("g2", "p2"), ("bytes", "cum"))])
    return rows.select(
        "c", "d", "length", "bytes", boundary.alias("boundary"),
        F.sum("g1").over(upto).alias("p1"), F.sum("g2").over(upto).alias("p2"), F.sum("bytes").over(upto).alias("cum"),
        F.last(F.when(start, digest), ignorenulls=True).over(before).alias("top"),
    )


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first d rebuilt turns (see ``rebuilt``); the root has d = 0 and no text. Its
    members are the rebuilt conversations that start with it, turnless ones included; ``conv_id`` is the smallest.
    ``n_leaves`` counts childless nodes of its subtree, itself included; ``saved_tokens`` sums (n_convs - 1) times the
    UTF-8 bytes of the last text over its subtree; ``ends_sha256`` hashes the ascending ids of members that end there,
    comma-joined (none: the empty string's hash). Long conversations cost rows, not memory; empty or null texts are
    empty; repeated rows are turns of their own (ties in turn keep order by role and text); other columns are ignored;
    an empty table has no root. Digests are sums of 42-bit hashes: two prefixes part only if they differ, and equal
    digests of different prefixes (about 2**-84 for a pair) would merge them.
    """
    turns, sizes = rebuilt(conversations)
    t = cut_lineage(_digests(turns, sizes, block).select(
        "c", "d", "length", "bytes", "boundary", "p1", "p2", "cum",
        F.col("top.d").alias("kd"), F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2"), F.col("top.cum").alias("kcum"),
    ), "trie_turns")
    by_depth = Window.partitionBy("c").orderBy("d")
    t = t.select(
        "*",
        F.lead("p1").over(by_depth).alias("n1"), F.lead("p2").over(by_depth).alias("n2"),
        F.lag("p1").over(by_depth).alias("q1"), F.lag("p2").over(by_depth).alias("q2"),
    )
    # each block end, with the block's start: do all members of a start reach the same end?
    ends = t.filter("boundary AND d > 0")
    parting = (
        ends.groupBy("kd", "k1", "k2")
        .agg((F.min(F.struct("d", "p1", "p2")) != F.max(F.struct("d", "p1", "p2"))).alias("parts"))
        .filter("parts")
        .select("kd", "k1", "k2", F.lit(True).alias("parts"))
    )
    marked = cut_lineage(t.join(parting, ["kd", "k1", "k2"], "left").withColumn("parts", F.coalesce("parts", F.lit(False))), "trie_marked")
    members = marked.filter("boundary OR parts OR d = 0")
    nodes = cut_lineage(
        members.groupBy("d", "p1", "p2").agg(
            F.count("*").alias("n_convs"),
            F.min("c").alias("conv_id"),
            F.min_by("bytes", "c").alias("rep_bytes"),
            F.count_distinct("n1", "n2").alias("n_children"),
            F.first("q1").alias("q1"), F.first("q2").alias("q2"),
            F.first("parts").alias("parts"), F.first("kd").alias("kd"),
            F.min_by(F.col("cum") - F.col("bytes"), "c").alias("rep_before"),
            F.min_by("kcum", "c").alias("rep_top"),
        ),
        "trie_nodes",
    )
    # a grouped node inside an unparted block hangs below derived nodes, which carry its members up to the block start
    chain = F.when(F.col("parts") | (F.col("d") == F.col("kd") + 1) | (F.col("d") == 0), F.lit(0)).otherwise(F.col("rep_before") - F.col("rep_top"))
    valued = nodes.select(
        "*",
        ((F.col("n_convs") - 1) * F.col("rep_bytes")).alias("own"),
        ((F.col("n_convs") - 1) * (F.col("rep_bytes") + chain)).alias("value"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    reps = valued.select("d", "p1", "p2", F.col("conv_id").alias("c"), "value", "leaf")
    mine = members.select("c", "d", "p1", "p2").join(reps, ["c", "d", "p1", "p2"], "left").fillna(0, ["value", "leaf"])
    deeper = Window.partitionBy("c").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    below = mine.select(
        "d", "p1", "p2",
        F.coalesce(F.sum("value").over(deeper), F.lit(0)).alias("v"), F.coalesce(F.sum("leaf").over(deeper), F.lit(0)).alias("l"),
    )
    sums = below.groupBy("d", "p1", "p2").agg(F.sum("v").alias("below"), F.sum("l").alias("leaves_below"))
    finished = cut_lineage(
        valued.join(sums, ["d", "p1", "p2"]).select(
            "*", (F.col("below") + F.col("own")).alias("saved_tokens"), (F.col("leaves_below") + F.col("leaf")).alias("n_leaves")
        ),
        "trie_finished",
    )
    parents = finished.select(F.col("d").alias("pd"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_grouped"))
    derived_parent = F.when(F.col("parts") | (F.col("d") == F.col("kd") + 1), F.lit(None)).otherwise(F.col("conv_id"))
    above = (parents.pd == finished.d - 1) & (parents.q1 == finished.q1) & (parents.q2 == finished.q2)
    grouped = finished.join(parents, above, "left").select(
        finished.conv_id, finished.d.alias("depth"),
        F.when(finished.d == 0, F.lit(None)).otherwise(F.coalesce(derived_parent, F.col("parent_grouped"))).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", finished.d.alias("_d"), finished.p1.alias("_p1"), finished.p2.alias("_p2"),
    )
    ended = marked.filter(F.col("d") == F.col("length")).select("d", "p1", "p2", "c")
    hashes = _end_hashes(ended)
    grouped = grouped.join(hashes, [grouped._d == hashes.d, grouped._p1 == hashes.p1, grouped._p2 == hashes.p2], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    # derived nodes: turns of a block's smallest member inside a block whose members do not part
    inside = marked.filter("NOT boundary AND NOT parts AND d > 0")
    tops = finished.select(
        F.col("conv_id").alias("c"), F.col("d").alias("end_d"), "n_convs", "n_leaves", "saved_tokens", "rep_before", "kd",
    )
    top_ids = finished.select(F.col("d").alias("sd"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("conv_id").alias("top_conv"))
    same_block = (F.col("end_d") > F.col("d")) & (F.floor((F.col("end_d") - 1) / block) == F.floor((F.col("d") - 1) / block))
    at_top = (top_ids.sd == inside.kd) & (top_ids.k1 == inside.k1) & (top_ids.k2 == inside.k2)
    derived = inside.join(tops.drop("kd"), "c").filter(same_block).join(top_ids, at_top, "left")
    derived = derived.select(
        "c", "d", "n_convs", "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * (F.col("rep_before") - (F.col("cum") - F.col("bytes")))).alias("saved_tokens"),
        F.when(F.col("d") == F.col("kd") + 1, F.col("top_conv")).otherwise(F.col("c")).alias("parent_conv_id"),
    ).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(EMPTY).alias("ends_sha256"),
    )
    return grouped.unionByName(derived).select(
        *[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        "ends_sha256",
    )


def _end_hashes(ended: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of nodes where members end: ids streamed through SHA-256 in ascending order.

    Rows are dealt by node and sorted within partitions, so a node with very many ends costs one pass, not memory.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, first, out = None, None, True, []
        for batch in batches:
            for d, p1, p2, c in zip(batch.d, batch.p1, batch.p2, batch.c):
                here = (int(d), int(p1), int(p2))
                if here != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest, first = here, hashlib.sha256(), True
                digest.update((b"" if first else b",") + str(int(c)).encode())
                first = False
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["d", "p1", "p2", "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["d", "p1", "p2", "ends_sha256"])

    dealt = ended.repartition("d", "p1", "p2").sortWithinPartitions("d", "p1", "p2", "c")
    return dealt.mapInPandas(stream, "d long, p1 long, p2 long, ends_sha256 string")

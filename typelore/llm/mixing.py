"""Interleaving sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. Block j of a source with share w may start at floor(j / w) and must have
started by ceil((j + 1) / w); of the blocks that may start, the one with the earliest deadline takes the next slot. With
shares that add up to one, every deadline is met, so after any number of slots each source is less than one block away
from its target. Shares are whole numbers of slots in a period, after which the schedule repeats: one period is worked
out, every document then finds its slot on its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typelore.session import cut_lineage

#: Slots in a period, and how many there are at least per source.
PERIOD = 1000
PER_SOURCE = 10
BLOCK = 100
#: Documents numbered by one task at a time.
STRETCH = 5_000


def schedule(slots: Mapping[str, int]) -> dict[str, list[int]]:
    """Places of each source within one period, for whole numbers of slots above zero."""
    if any(w <= 0 for w in slots.values()):
        raise ValueError("a source has no slot")
    period = sum(slots.values())
    placed: dict[str, list[int]] = {name: [] for name in slots}
    waiting = [(0, name) for name in sorted(slots)]  # by release time
    ready: list[tuple[int, str]] = []  # by deadline
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, name = heapq.heappop(waiting)
            done = len(placed[name]) + 1
            heapq.heappush(ready, (-(-done * period // slots[name]), name))
        _, name = heapq.heappop(ready)
        placed[name].append(now)
        if (done := len(placed[name])) < slots[name]:
            heapq.heappush(waiting, (done * period // slots[name], name))
    return placed


def smoothed(counts: Mapping[str, int], power: float = 0.9, period: int = PERIOD) -> dict[str, int]:
    """Slots in proportion to ``count ** power``, one at least, rounded so that they fill the period."""
    if len(counts) > period:
        raise ValueError(f"{len(counts)} sources do not fit into a period of {period}; group them first")
    total = sum(n**power for n in counts.values())
    exact = {name: n**power / total * (period - len(counts)) for name, n in counts.items()}
    slots = {name: 1 + int(x) for name, x in exact.items()}
    by_rest = sorted(exact, key=lambda name: (int(exact[name]) - exact[name], name))
    for name in by_rest[: period - sum(slots.values())]:
        slots[name] += 1
    return slots


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _numbered(df: DataFrame, source: str, order: Column) -> DataFrame:
    """Adds ``_n``: the number of each row within its source, in hashed order.

    A source is dealt into stretches by its hash, which are numbered apart and begin where the ones before them end, so
    a source with most of the rows is numbered in parallel. The counts that give the beginnings are one per stretch.
    """
    dealt = df.withColumns({"_key": _key(source), "_order": order})
    sizes = dealt.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select("_key", F.ceil(F.col("_size") / STRETCH).alias("_stretches"))
    # one row per source
    spot = F.pmod(F.col("_order"), F.lit(1 << 40)) / float(1 << 40)
    placed = dealt.join(F.broadcast(sizes), "_key").withColumn("_stretch", F.floor(spot * F.col("_stretches")))
    counted = placed.groupBy("_key", "_stretch").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("_key", "_stretch", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("_key", "_stretch").orderBy(spot, "_order")
    numbered = placed.withColumn("_rank", F.row_number().over(within)).drop("_stretches")
    joined = numbered.join(cut_lineage(begins, "stretches"), ["_key", "_stretch"])
    return joined.withColumn("_n", F.col("_begin") + F.col("_rank") - 1).drop("_begin", "_rank", "_stretch")


def mix(
    df: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    slots: Mapping[str | None, int] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``mix_slot``, ``mix_block`` (within the source) and ``mix_round`` (0 at first, 1 when repeated, and so on).

    ``slots`` gives whole numbers per source; sources without one do not take part. Without ``slots`` all sources take
    part, by ``smoothed`` counts in a period that grows with their number. The mix is as long as it takes for every document of the scarcest share to come up
    once; sources that run out before that start again, so nothing is dropped and the shares hold to the end. The last
    block of a source may hold fewer documents.

    A null source is a source of its own; a null id is a document like any other; repeated rows are dealt one by one. An
    empty table gives an empty result. Other columns are kept, except that one with the name of a new column is an error.
    """
    new = {"mix_slot", "mix_block", "mix_round"}
    clash = (new | {"_key", "_order", "_n"}) & set(df.columns)
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
    keyed = df if slots is None else df.filter(_key(source).isin([_plain(name) for name in slots]))
    counts = {r[0]: r[1] for r in keyed.groupBy(_key(source)).count().collect()}
    share = smoothed(counts, period=max(PERIOD, PER_SOURCE * len(counts))) if slots is None else {_plain(k): w for k, w in slots.items() if _plain(k) in counts}
    places = schedule(share) if share else {}
    period = sum(share.values())
    blocks = {name: -(-counts[name] // block) for name in share}
    # whole slots until the last source has shown all its blocks
    length = max((_slot(places[name], period, blocks[name] - 1) + 1 for name in share), default=0)
    rows = []
    for name, at in places.items():
        turns = length // period * len(at) + sum(x < length % period for x in at)
        rows.append((name, at, len(at), blocks[name], turns))
    kind = T.StructType([
        T.StructField("_key", T.StringType()), T.StructField("_places", T.ArrayType(T.LongType())),
        T.StructField("_share", T.LongType()), T.StructField("_blocks", T.LongType()), T.StructField("_turns", T.LongType()),
    ])
    plan = F.broadcast(df.sparkSession.createDataFrame(rows, kind))  # one row per source
    numbered = _numbered(keyed, source, F.xxhash64(doc_id))
    blocked = numbered.withColumn("mix_block", F.floor(F.col("_n") / block)).join(plan, "_key")
    last = F.floor((F.col("_turns") - 1 - F.col("mix_block")) / F.col("_blocks"))
    turns = blocked.withColumn("mix_round", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    turn = F.col("mix_round") * F.col("_blocks") + F.col("mix_block")
    slot = F.floor(turn / F.col("_share")) * period + F.get("_places", (turn % F.col("_share")).cast("int"))
    return turns.withColumn("mix_slot", slot).select(*df.columns, "mix_slot", "mix_block", "mix_round")


def _plain(name: str | None) -> str:
    return "" if name is None else f"={name}"


def _slot(places: list[int], period: int, turn: int) -> int:
    return turn // len(places) * period + places[turn % len(places)]


def in_order(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``mix`` dealt and sorted by slot, so that files written from it follow the mix."""
    return mixed.repartitionByRange(F.col("mix_slot"), F.xxhash64(doc_id)).sortWithinPartitions("mix_slot", F.xxhash64(doc_id))

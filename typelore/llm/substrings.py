"""Removal of word sequences that repeat across documents, found through difference-cover anchors.

Words are hashed in windows of 20 only where the place modulo 31 is in a difference cover: every difference modulo 31 is
a difference of two members. So for any two places of 50 equal words there is an offset below 31 that takes both to the
cover: the documents share an aligned anchor. Only around shared anchors are the full windows of 50 words hashed, and a
window is removed where a document with a smaller id has it.

Both times the question is who else has a hash. Entries travel packed, one row per task and range of hashes, to where
the ranges are put together. A hash that is frequent within a task goes there as one summary of its documents; its
entries are dealt by document too, and the answer is sent to all parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typelore.llm import word_hashes as W
from typelore.llm.expressions import words
from typelore.session import cut_lineage

WINDOW = 50
#: A perfect difference set: each number from 1 to 30 is exactly one difference modulo 31. Fixed values.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

#: Entries packed together by a task, from how many entries of one hash on it is summed up, and entries per range.
FLUSH, FREQUENT, RANGE = 1 << 19, 64, 200_000
#: Ranges of which frequent hashes are settled together, and parts into which their documents are dealt.
WIDE, SALTS = 16, 32

Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # hash, doc, row, place


def _packed(parts: Iterator[Entries], ranges: int) -> Iterator[pa.RecordBatch]:
    held: list[Entries] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= FLUSH:
            yield _flush(held, ranges)
            held, size = [], 0
    if size:
        yield _flush(held, ranges)


def _flush(held: list[Entries], ranges: int) -> pa.RecordBatch:
    hashes, doc, row, place = (np.concatenate([h[i] for h in held]) for i in range(4))
    _, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    bucket = (hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
    often = counts[which] >= FREQUENT
    if often.any():
        low, high = np.full(len(counts), np.iinfo(np.int64).max), np.full(len(counts), np.iinfo(np.int64).min)
        np.minimum.at(low, which[often], doc[often])
        np.maximum.at(high, which[often], doc[often])
        frequent = np.flatnonzero(counts >= FREQUENT)
        at = first[frequent]
        none = np.full(len(frequent), -1, np.int64)
        # entries of frequent hashes are dealt by their document as well, behind the ranges
        salt = (W.mix(doc[often].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
        bucket[often] = ranges + bucket[often] // WIDE * SALTS + salt
        hashes = np.concatenate([hashes, hashes[at], hashes[at]])
        doc, row = np.concatenate([doc, low[frequent], high[frequent]]), np.concatenate([row, none, none])
        place = np.concatenate([place, none.astype(np.int32), none.astype(np.int32)])
        own = (hashes[len(bucket):] >> shift).astype(np.int64) if ranges > 1 else np.zeros(2 * len(at), np.int64)
        bucket = np.concatenate([bucket, own])
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    ends = [*starts[1:], len(order)]
    columns = []
    for values in (hashes, doc, row, place):
        sorted_ = values[order]
        columns.append(pa.array([sorted_[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(names), *columns], ["bucket", "hashes", "docs", "rows", "places"])


_ENTRY = {"hashes": np.uint64, "docs": np.int64, "rows": np.int64, "places": np.int32}
_MARK = "kind int, bucket long, row long, at array<int>, hash long, low long"
_PACKED = "hashes binary, docs binary, rows binary, places binary"


def _unpacked(frame) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(frame[name]), kind) for name, kind in _ENTRY.items()]


def _places_by_row(row: np.ndarray, place: np.ndarray) -> dict:
    import pandas as pd

    order = np.argsort(row, kind="stable")
    names, starts = np.unique(row[order], return_index=True)
    parts = np.split(place[order], starts[1:]) if len(names) else []
    return {"row": names.astype(np.int64), "at": pd.Series(parts, dtype=object)}


def _shared(packed: DataFrame, ranges: int, later_only: bool, name: str) -> DataFrame:
    """(row, places) of the entries whose hash is in another document too, or in one with a smaller id (``later_only``)."""

    def gather(frame):
        import pandas as pd

        own = int(frame["bucket"].iloc[0])
        if own >= ranges:  # frequent hashes: as they are, to be settled below
            return frame[["bucket", *_ENTRY]].assign(kind=2, row=0, at=None, hash=0, low=0)
        hashes, doc, row, place = _unpacked(frame)
        order = np.argsort(hashes, kind="stable")
        hashes, doc, row, place = hashes[order], doc[order], row[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(hashes)]]))
        low, high = (np.repeat(f.reduceat(doc, starts), sizes) for f in (np.minimum, np.maximum))
        found = (low != high) & (place >= 0) & ((doc > low) | (not later_only))
        plain = pd.DataFrame(_places_by_row(row[found], place[found])).assign(kind=0, bucket=0, hash=0, low=0)
        summed, at = np.unique(hashes[place < 0], return_index=True)
        low, high = low[place < 0][at], high[place < 0][at]
        shared = low != high
        hot = pd.DataFrame({"hash": summed.view(np.int64)[shared], "low": low[shared]})
        hot = hot.assign(kind=1, bucket=ranges + own // WIDE * SALTS, row=0, at=None)
        return pd.concat([plain, hot]).assign(**dict.fromkeys(_ENTRY))

    order = ["kind", "bucket", "row", "at", "hash", "low", *_ENTRY]
    marks = cut_lineage(
        packed.groupBy("bucket").applyInPandas(lambda frame: gather(frame)[order], f"{_MARK}, {_PACKED}"), name
    )
    # the answers to frequent hashes go to all parts of their documents
    answers = marks.filter("kind = 1").select(
        F.explode(F.sequence("bucket", F.col("bucket") + (SALTS - 1))).alias("bucket"), "hash", "low"
    )

    def settle(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "places": []}).astype({"row": "int64", "places": object})
        hashes, doc, row, place = _unpacked(left)
        known = right.sort_values("hash")
        values, low = known["hash"].to_numpy(), known["low"].to_numpy()
        spot = np.minimum(np.searchsorted(values, hashes.view(np.int64)), len(values) - 1)
        found = (values[spot] == hashes.view(np.int64)) & ((doc > low[spot]) | (not later_only))
        out = pd.DataFrame(_places_by_row(row[found], place[found]))
        return out.rename(columns={"at": "places"}).astype({"row": "int64"})

    entries = marks.filter("kind = 2").select("bucket", *_ENTRY)
    frequent = entries.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(settle, "row long, places array<int>")
    found = marks.filter("kind = 0").select("row", F.col("at").alias("places")).union(frequent)
    return found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def _anchors(texts: list[bytes], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    length = window - PERIOD + 1
    hashes, begins = W.words_of(texts)
    whole = W.windows(hashes, length)
    for i, (start, end) in enumerate(zip(begins, begins[1:], strict=False)):
        if end - start >= window:
            place = np.arange(end - start - length + 1, dtype=np.int32)
            place = place[np.isin(place % PERIOD, COVER)]
            yield i, whole[start + place], place


def _candidate_windows(n: int, anchors: np.ndarray, window: int) -> np.ndarray:
    """Places of the windows of a text of ``n`` words that hold an anchor."""
    near = np.zeros(n + 2, np.int64)
    np.add.at(near, np.maximum(anchors - (PERIOD - 1), 0), 1)
    np.add.at(near, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(near)[: n - window + 1] > 0).astype(np.int32)


def _batches(arrow: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _ranges(entries: float) -> int:
    return 1 << max(6, int(np.ceil(np.log2(max(entries, 1) / RANGE))))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row; ``removed`` holds what to cut, for rows that lose words.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a smaller id, judged
    on the input. ``kept_sha256`` is of the kept words joined by single spaces. Rows with equal texts are looked at
    once, for the smallest id; all others of them lose everything if they have a window at all.

    A null or empty text has no words. A row without id is no source and loses nothing. Rows that repeat an id are no
    sources for each other. ``removed`` is an array of (start, end) word places, null where nothing is removed.
    """
    if window < PERIOD + 8:
        raise ValueError("the window is too short for anchors")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), whole.alias("t")).withColumn("h", F.xxhash64("t", F.length("t")))
    known = rows.filter("id IS NOT NULL")
    firsts = cut_lineage(known.groupBy("h").agg(F.min("id").alias("first")), "firsts")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    # anchors, with equal texts as one document
    ranges = _ranges(size / 6 * len(COVER) / PERIOD)

    def anchors(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[Entries]:
            for batch in _batches(arrow):
                own = batch.column("h").to_numpy()
                for i, hashes, place in _anchors(batch.column("b").to_pylist(), window):
                    doc = np.full(len(place), own[i])
                    yield hashes, doc, doc, place

        return _packed(parts(), ranges)

    packed_schema = "bucket long, hashes binary, docs binary, rows binary, places binary"
    packed = known.select("h", F.col("t").cast("binary").alias("b")).mapInArrow(anchors, packed_schema)
    anchored = _shared(packed, ranges, False, "anchors").withColumnRenamed("row", "h")
    wanted = anchored.join(firsts, "h").withColumnRenamed("first", "id")
    # one row per text that may share a window; rows that repeat id and text stand for the same
    near = known.join(wanted, ["id", "h"]).withColumn("row", F.monotonically_increasing_id())
    near = cut_lineage(near.select("id", "h", "row", F.col("t").cast("binary").alias("b"), "places"), "near")
    inside = near.agg(F.sum(F.size("places"))).first()[0] or 0
    ranges_2 = _ranges(inside * 8)

    def full(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[Entries]:
            for batch in _batches(arrow):
                hashes, begins = W.words_of(batch.column("b").to_pylist())
                ids, numbers, places = (batch.column(c) for c in ("id", "row", "places"))
                whole = W.windows(hashes, window)
                for i in range(batch.num_rows):
                    at = places[i].values.to_numpy()
                    place = _candidate_windows(int(begins[i + 1] - begins[i]), at, window)
                    doc, row = (np.full(len(place), c[i].as_py(), np.int64) for c in (ids, numbers))
                    yield whole[begins[i] + place], doc, row, place

        return _packed(parts(), ranges_2)

    windows = near.select("id", "row", "b", "places").mapInArrow(full, packed_schema)
    repeated = _shared(windows, ranges_2, True, "windows").withColumnRenamed("places", "starts")

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in _batches(arrow):
            removed, sha, spans = [], [], []
            for data, starts in zip(batch.column("b").to_pylist(), batch.column("starts"), strict=True):
                _, begin, end = W.words(data)
                covered = np.zeros(len(begin) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(covered, at, 1)
                np.add.at(covered, at + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                kept = [data[s:e] for s, e in zip(begin[~gone].tolist(), end[~gone].tolist(), strict=True)]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            columns = [pa.array(removed, pa.int64()), pa.array(sha), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), *columns], ["id", "h", "n_cut", "sha", "spans"]
            )

    cuts = near.select("id", "h", "row", "b").join(repeated, "row").select("id", "h", "b", "starts").mapInArrow(
        cut, "id long, h long, n_cut long, sha string, spans array<struct<start:int,end:int>>"
    )
    found = cut_lineage(cuts, "cuts").dropDuplicates(["id", "h"])

    tokens = words(F.col("t"))
    base = rows.select(
        "id", "h", F.size(tokens).cast("long").alias("n_words"), F.sha2(F.array_join(tokens, " "), 256).alias("all")
    )
    joined = base.join(firsts, "h", "left").join(found, ["id", "h"], "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return joined.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "all")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.col("spans")).alias("removed"),
    )

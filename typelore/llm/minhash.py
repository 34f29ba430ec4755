"""Near-duplicate documents by MinHash and a multi-index join over b-bit signatures.

A signature has ``slots`` values of 16 bits. Two documents of Jaccard similarity s differ in each slot with probability
at most 1 - s, so for links at ``threshold`` the signature distance (slots that differ) stays within ``reach`` except
with probability ``miss``. The slots are cut into chunks such that, by the pigeonhole principle, signatures within
``reach`` of each other have a chunk with at most one error. Those errors are enumerated as the chunk with each slot
left out in turn: all pairs within ``reach`` share a key. Candidates are then confirmed on the full sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.llm import word_hashes as W
from typelore.llm.components import components
from typelore.session import cut_lineage

_RANDOM = np.random.default_rng(987654321)
_XOR = _RANDOM.integers(0, 2**32, 256, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Signatures, and full sets, that are compared with as many others at a time.
BLOCK, SETS = 512, 256


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``k`` words, links from ``percent`` per cent of Jaccard similarity on."""

    k: int = 5
    percent: int = 80
    slots: int = 64
    miss: float = 1e-6

    @property
    def reach(self) -> int:
        """Largest signature distance that is searched."""
        p = 1 - self.percent / 100
        tail = 1.0
        for d in range(self.slots + 1):
            tail -= math.comb(self.slots, d) * p**d * (1 - p) ** (self.slots - d)
            if tail <= self.miss:
                return d
        return self.slots

    @property
    def chunks(self) -> list[range]:
        """Chunks with one error allowed in each: two errors more than half as many chunks cannot be escaped."""
        m = self.reach // 2 + 1
        cuts = [round(i * self.slots / m) for i in range(m + 1)]
        return [range(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]


# ---- sets and signatures -----------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a text of fewer words is one shingle, an empty one none."""
    hashes, begins = W.words_of([t.lower() for t in texts])  # bytes.lower() is A-Z only
    whole = W.windows(hashes, k)
    sets = []
    for start, end in zip(begins, begins[1:], strict=False):
        n = int(end - start)
        found = whole[start : end - k + 1] if n >= k else W.windows(hashes[start:end], n) if n else whole[:0]
        sets.append(np.unique(found))
    return sets


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Rows of 16-bit values; those of empty sets mean nothing."""
    out = np.zeros((len(sets), slots), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j in range(slots):
            with np.errstate(over="ignore"):
                values = (flat ^ _XOR[j]) * _ODD[j]
            out[full, j] = np.minimum.reduceat(values, begins).astype(np.uint16)
    return out


def _parts(arrow: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _features(df: DataFrame, doc_id: str, text: str, how: Similarity) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(arrow, 128):
            sets = shingle_sets([t or b"" for t in part.column(1).to_pylist()], how.k)
            with np.errstate(over="ignore"):
                sums = np.array([[s.sum(), W.mix(s ^ np.uint64(how.k)).sum()] for s in sets], np.uint64).astype(np.int64)
            packed = [row.tobytes() for row in signatures(sets, how.slots)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            sums = sums.reshape(-1, 2)
            columns = [sizes, pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(packed, pa.binary())]
            names = ["id", "h", "n", "f1", "f2", "sig"]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], names)

    return _sources(df, doc_id, text).mapInArrow(run, "id long, h long, n long, f1 long, f2 long, sig binary")


def _sources(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(text).cast("binary")
    return df.select(F.col(doc_id).cast("long").alias("id"), whole.alias("t"), F.xxhash64(whole).alias("h"))


# ---- candidates --------------------------------------------------------------------------------------------------------


def _keys(how: Similarity) -> Column:
    """The chunks with one slot left out each, hashed together with their place."""
    keys = []
    for chunk in how.chunks:
        for out in chunk:
            left = F.substring("sig", 2 * chunk.start + 1, 2 * (out - chunk.start))
            right = F.substring("sig", 2 * out + 3, 2 * (chunk.stop - out - 1))
            keys.append(F.xxhash64(F.lit(out), left, right))
    return F.array(*keys)


def _within_reach(pairs: DataFrame, reps: DataFrame, how: Similarity) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures are within reach."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * how.percent)
        .select("a", "b", "sig_a", "sig_b")
    )

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            one, two = (_matrix(batch.column(i), how.slots) for i in (2, 3))
            near = (one != two).sum(axis=1) <= how.reach
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return sized.mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, slots)


def _confirmed(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("t_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("t").alias("t_b")), "b"
    )

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(arrow, 64):
            n = part.num_rows
            sets = shingle_sets([*part.column("t_a").to_pylist(), *part.column("t_b").to_pylist()], how.k)
            linked = []
            for one, two in zip(sets[:n], sets[n:], strict=True):
                shared = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(shared > 0 and 100 * shared >= how.percent * (len(one) + len(two) - shared))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _near(members: DataFrame, labels: DataFrame, reps: DataFrame, how: Similarity) -> DataFrame:
    """(a, b): edges that connect what pairs within reach connect, where such pairs have no common label yet.

    Buckets are cut into blocks of some hundred members, those with the bucket's most frequent label apart from the rest,
    as they need not meet each other. A task compares two blocks at a time as matrices of signatures and puts out one row
    per member of a group found, never the pairs.
    """
    labelled = (
        members.join(labels, F.col("id") == F.col("node"), "left")
        .select("key", "hub", "id", F.coalesce("label", "id").alias("label"))
    )
    open_ = labelled.join(_cuts(labelled, "key", 3, BLOCK), "key").join(reps.select("id", "n", "sig"), "id")
    dealt = _block_pairs(open_, ["key"], ["hub", "id", "label", "n", "sig"])

    def groups(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, label, n, hub = (group.column(c).to_numpy() for c in ("id", "label", "n", "hub"))
        left, right = _sides(group)
        if not len(left) or not len(right):
            return
        sig = _matrix(group.column("sig"), how.slots)
        apart = np.zeros((len(left), len(right)), np.uint8)
        for slot in range(how.slots):
            apart += sig[left, slot][:, None] != sig[right, slot]
        # pairs with the smallest member of the bucket have been looked at before
        done = (hub[left] == ids[left])[:, None] | (hub[right] == ids[right])
        near = (apart <= how.reach) & ~done & _open(label, n, left, right, how)
        x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(x):
            near = near[np.ix_(x, y)]
            one, two = ids[left[x]], ids[right[y]]
            low_x, low_y = one.copy(), two.copy()
            far = np.iinfo(np.int64).max
            while True:
                new_x = np.minimum(low_x, np.where(near, low_y, far).min(axis=1))
                new_y = np.minimum(low_y, np.where(near, new_x[:, None], far).min(axis=0))
                if (new_x == low_x).all() and (new_y == low_y).all():
                    break
                low_x, low_y = new_x, new_y
            both, at = np.unique(np.concatenate([one, two]), return_index=True)
            low = np.concatenate([low_x, low_y])[at]
            yield _pair_batch(low[low != both], both[low != both])

    return dealt.mapInArrow(_by_group(groups, ("key", "i", "j")), "a long, b long")


def _links_within(clusters: DataFrame, labels: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) between different components within each cluster, from the full sets, as many as it takes to join them.

    Clusters are cut into blocks, as buckets are; a task intersects all sets of two blocks by counting, and only puts out
    a link where it joins two components that no other link of these blocks has joined.
    """
    known = labels.select(F.col("node").alias("id"), "label")
    own = clusters.select(F.col("node").alias("id"), F.col("label").alias("cluster")).join(known, "id", "left")
    own = cut_lineage(own.withColumn("label", F.coalesce("label", "id")), "clusters")
    rows = own.join(_cuts(own, "cluster", 2, SETS), "cluster").join(texts, "id")
    dealt = _block_pairs(rows, ["cluster"], ["id", "label", "t"])

    def links(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, label = (group.column(c).to_numpy() for c in ("id", "label"))
        left, right = _sides(group)
        if not len(left) or not len(right):
            return
        sets = shingle_sets(group.column("t").to_pylist(), how.k)
        n = np.array([len(x) for x in sets])
        flat = np.concatenate([sets[y] for y in right])
        begins = np.concatenate([[0], np.cumsum(n[right])[:-1]])
        wanted = _open(label, n, left, right, how)
        root = {x: x for x in label.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        for i, x in enumerate(left):
            if not wanted[i].any():
                continue
            found = np.zeros(len(flat), np.int64)
            low, high = np.searchsorted(ordered, sets[x], "left"), np.searchsorted(ordered, sets[x], "right")
            spots = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
            found[order[spots]] = 1
            shared = np.add.reduceat(found, begins)
            linked = wanted[i] & (100 * shared >= how.percent * (n[x] + n[right] - shared))
            for y in right[linked].tolist():
                one, two = top(int(label[x])), top(int(label[y]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    a.append(ids[x])
                    b.append(ids[y])
        yield _pair_batch(np.array(a, np.int64), np.array(b, np.int64))

    return dealt.mapInArrow(_by_group(links, ("cluster", "i", "j")), "a long, b long")


def _cuts(labelled: DataFrame, key: str, least: int, block: int) -> DataFrame:
    """(key, common, rest, others) of the groups with several labels and ``least`` members, written.

    A group beyond one block has ``others`` blocks for the members with its most frequent label, ``common``, and
    ``rest`` blocks for all others. A smaller group is one block.
    """
    sizes = labelled.groupBy(key).agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
    )
    sizes = cut_lineage(sizes.filter((F.col("low") < F.col("high")) & (F.col("size") >= least)).select(key, "size"), "sizes")
    large = labelled.join(sizes.filter(F.col("size") > block).select(key), key)
    counted = large.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    common = counted.groupBy(key).agg(F.max(F.struct("n", "label")).alias("top")).select(
        key, F.col("top.label").alias("common"), F.col("top.n").alias("top")
    )
    cut = sizes.join(common, key, "left").withColumn("top", F.coalesce("top", F.lit(0)))
    rest, others = ((n / block) for n in (F.col("size") - F.col("top"), F.col("top")))
    return cut_lineage(
        cut.select(key, "common", F.ceil(rest).cast("int").alias("rest"), F.ceil(others).cast("int").alias("others")), "cuts"
    )


def _block_pairs(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each row once for every block it has to meet, dealt and sorted by the pair (i, j) of blocks; ``own`` is its block.

    The blocks of the rest come first and meet all blocks of their group; those of the common label meet only the rest.
    So where one label holds most of a large group, nearly all of its rows come up once or a few times.
    """
    is_common = F.coalesce(F.col("label") == F.col("common"), F.lit(False))
    place = F.xxhash64("id")
    own = F.when(is_common, F.col("rest") + F.pmod(place, F.greatest("others", F.lit(1)))).otherwise(F.pmod(place, "rest"))
    meets = F.when(is_common, F.col("rest")).otherwise(F.col("rest") + F.col("others"))
    other = F.explode(F.sequence(F.lit(0), meets - 1))
    both = rows.withColumn("own", own.cast("int")).withColumn("other", other).select(
        *keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns
    )
    return both.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "id")


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and the second block; both are all rows where a block meets itself."""
    first, second, own = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("own").to_numpy()
    return np.flatnonzero(own == first), np.flatnonzero(own == second)


def _open(label: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, how: Similarity) -> np.ndarray:
    """Pairs of different components whose sizes allow a link."""
    least, most = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    return (label[left][:, None] != label[right]) & (100 * least >= how.percent * most)


def _by_group(work, keys: tuple[str, ...]):
    """Calls ``work`` with the rows of one group after the other, from batches sorted by the keys."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in arrow:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.concat_batches([held, batch])
            names = [table.column(c).to_numpy() for c in keys]
            start = 0
            for cut in np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1:
                yield from work(table.slice(start, cut - start))
                start = int(cut)
            held = table.slice(start)
        if held is not None:
            yield from work(held)

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# ---- operator ----------------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Similarity | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) per row; the component is the smallest id that links reach.

    Rows with equal sets become one representative first, so copies cost one row each. In each bucket of the index all
    members are compared with its smallest one. Members that are in no common component after that but within reach of each
    other form clusters, whose full sets are compared block by block. So no link between different texts is lost, and no
    group is expanded into rows of pairs. Members that share the most frequent label of a large group are not dealt to
    each other's blocks.

    A null or empty text has no shingles, is its own component and is kept. A row without id has no component and is
    kept. Rows that repeat an id keep their own set; they belong together if their sets do. ``text_hash`` is ``xxhash64`` of
    the text as binary and parts such rows. Other columns do no harm.
    """
    how = how or Similarity()
    rows = cut_lineage(_features(df, doc_id, text, how), "signatures")
    # a repeated id may stand for several sets, so a representative has an id of its own: the hash of its set
    same = rows.filter("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n")
    reps = cut_lineage(
        same.agg(F.min(F.struct("id", "h")).alias("first"), F.first("sig").alias("sig")).select(
            F.xxhash64("f1", "f2", "n").alias("id"), "f1", "f2", "n", "sig", "first.*"
        ).toDF("id", "f1", "f2", "n", "sig", "doc", "h"),
        "reps",
    )
    keys = reps.select("id", F.explode(_keys(how)).alias("key"))
    buckets = cut_lineage(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = cut_lineage(keys.join(buckets.select("key", "hub"), "key"), "members")
    stars = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = cut_lineage(_within_reach(stars, reps, how), "pairs")
    # only documents in some bucket can be needed below; a text is looked up by id and hash, which part repeated ids
    wanted = members.select("id").distinct().join(reps.select("id", "doc", "h"), "id")
    sources = _sources(df, doc_id, text).withColumnRenamed("id", "doc")
    found = sources.join(wanted, ["doc", "h"]).dropDuplicates(["doc", "h"])
    texts = cut_lineage(found.select("id", "t"), "texts")
    links = cut_lineage(_confirmed(first, texts, how), "links")
    labels = components(links)
    # what is within reach of the smallest member of a large bucket is near already, so that one label holds most of it
    large = members.join(buckets.filter(F.col("size") > BLOCK).select("key"), "key").filter("id <> hub")
    hubs = large.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = cut_lineage(links.union(first.join(hubs, ["a", "b"])), "near")
    # a quarter of the buckets joins most of what is near, so that little is left to compare in the others
    some = F.pmod("key", F.lit(4)) == 0
    near = near.union(cut_lineage(_near(members.filter(some), components(near), reps, how), "near"))
    near = near.union(cut_lineage(_near(members.filter(~some), components(near), reps, how), "near"))
    more = cut_lineage(_links_within(components(near), labels, texts, how), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    # labels are by representative; the component is named after its smallest document
    named = reps.join(labels, F.col("id") == F.col("node"), "left").select(
        "f1", "f2", "n", "doc", F.coalesce("label", "id").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("doc").alias("component"))
    by_set = cut_lineage(named.join(smallest, "label").select("f1", "f2", "n", "component"), "components")
    own = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), own)
    return rows.select("id", "n", "f1", "f2", "h").join(by_set, ["f1", "f2", "n"], "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        F.col("h").alias("text_hash"),
    )

import random
import re

import numpy as np

from typelore.llm import minhash as M
from typelore.llm import queries

HOW = M.Similarity(k=3, percent=85)


def shingles(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for pair in {(a, b) for at in where.values() for a in at for b in at if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            one, two = sorted(map(root, pair))
            label[two] = one
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def _check(frame, rows, how=HOW):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(frame, how=how).collect()}
    assert got == brute(rows, how.k, how.percent)


def test_guarantee_of_the_index():
    for how in (HOW, M.Similarity(), M.Similarity(slots=48, percent=90)):
        chunks = how.chunks
        assert [s for c in chunks for s in c] == list(range(how.slots))
        assert 2 * len(chunks) > how.reach
    rng = np.random.default_rng(1)
    for _ in range(200):
        wrong = set(rng.choice(HOW.slots, HOW.reach, replace=False).tolist())
        assert any(len(wrong & set(c)) <= 1 for c in HOW.chunks)


def test_slots_agree_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 2**63, (200, 85), dtype=np.uint64) * np.uint64(2)
    sets = []
    for row in shared:
        one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (8, 7))
        sets += [np.concatenate([row, one]), np.concatenate([row, two])]
    sig = M.signatures([M.W.mix(s) for s in sets], 64)
    apart = (sig[::2] != sig[1::2]).mean(axis=1) * 64
    assert abs(apart.mean() - 9.6) < 0.8 and apart.max() <= HOW.reach


def test_edits_copies_chains_and_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SETS", 5)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.randint(20, 150))
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((base * 1000 + len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    rows += [(90_000 + i, t) for i, t in enumerate([None, "", "  \n", "one", "ONE", "one two", "One  Two", "a b c", "É", "é"])]
    rows += [(99_000 + i, "same words in each of these rows again") for i in range(40)]
    _check(docs(rows), rows)
    _check(docs(rows), rows, M.Similarity())


def test_given_documents(spark, sf_dir):
    frame = queries.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    _check(frame, rows)


def test_odd_rows(spark, docs):
    text = "a few words that are the same in both rows"
    rows = [(None, text), (5, text), (5, text), (7, text), (5, "quite another text stands here"), (8, "x " * 50_000)]
    got = sorted(map(tuple, M.near_duplicates(docs(rows), how=HOW).drop("text_hash").collect()), key=repr)
    assert got == sorted(
        [(None, 8, None, True), (5, 8, 5, True), (5, 8, 5, True), (7, 8, 5, False), (5, 3, 5, True), (8, 1, 8, True)],
        key=repr,
    )
    assert M.near_duplicates(docs(rows).limit(0)).count() == 0


def test_a_large_near_group_is_not_dealt_to_all_its_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        copy = list(words)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    dealt, plain = [], M._block_pairs

    def counted(given, keys, columns):
        out = plain(given, keys, columns)
        if keys == ["key"]:
            dealt.append((given.count(), out.count()))
        return out

    monkeypatch.setattr(M, "_block_pairs", counted)
    _check(docs(rows), rows)
    assert len(dealt) == 2 and sum(m for _, m in dealt) < 3000  # some 20,000 rows where every block met every other

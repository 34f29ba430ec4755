import hashlib
import random
import re

from typelore.llm import queries
from typelore.llm import substrings as S


def brute(rows, window=50):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _check(frame, rows):
    got = S.remove_repeats(frame).drop("removed").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_cover():
    differences = {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER}
    assert differences == set(range(S.PERIOD))


def test_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 3)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 80, 200)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                start = rng.choice([0, 0, rng.randrange(len(p))])
                parts += p[start:]
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(20_000 + i, " ".join(passages[5])) for i in range(30)]
    rows += [(30_000, "same " * 120), (30_001, "same " * 70), (30_002, "same " * 49), (30_003, None), (30_004, "")]
    rows += [(40_000, " ".join(passages[4])), (40_000, " ".join(passages[3] + passages[4])), (40_000, " ".join(passages[4]))]
    rows += [(None, " ".join(passages[5])), (50_000, " ".join(word() for _ in range(30_000)))]
    _check(docs(rows), rows)
    assert S.remove_repeats(docs(rows).limit(0)).count() == 0


def test_given_documents(spark):
    frame = queries.table(spark, "/root/testdata/sf0.01", "documents")
    _check(frame, [(r.doc_id, r.text) for r in frame.collect()])

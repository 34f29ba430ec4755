import random

import pytest
from pyspark.sql import functions as F

from typelore.llm import mixing as M
from typelore.llm import queries


def test_schedule_keeps_every_source_within_a_block():
    rng = random.Random(1)
    for _ in range(40):
        slots = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 12))}
        places, period = M.schedule(slots), sum(slots.values())
        owner = {at: name for name, all_ in places.items() for at in all_}
        assert sorted(owner) == list(range(period))
        done = dict.fromkeys(slots, 0)
        for t in range(1, 2 * period + 1):
            done[owner[(t - 1) % period]] += 1
            assert all(abs(done[s] * period - slots[s] * t) < period for s in slots)


def test_smoothed_slots_fill_the_period():
    slots = M.smoothed({"a": 100_000, "b": 1, "c": 40})
    assert sum(slots.values()) == M.PERIOD and min(slots.values()) >= 1 and slots["a"] > slots["c"] >= slots["b"]
    with pytest.raises(ValueError):
        M.smoothed({str(i): 1 for i in range(1001)})
    with pytest.raises(ValueError):
        M.schedule({"a": 1, "b": 0})


def brute(rows, slots, block):
    """Fill the slots one after the other, each with the next block of its source."""
    by_source = {}
    for i, s in rows:
        by_source.setdefault(s, []).append(i)
    n_blocks = {s: -(-len(v) // block) for s, v in by_source.items()}
    places = M.schedule({M._plain(s): w for s, w in slots.items()})
    owner = {at: s for s in slots for at in places[M._plain(s)]}
    period, done, out, t = len(owner), dict.fromkeys(slots, 0), [], 0
    while any(done[s] < n_blocks[s] for s in slots):
        s = owner[t % period]
        out.append((t, s, done[s] % n_blocks[s], done[s] // n_blocks[s]))
        done[s] += 1
        t += 1
    return out


def test_against_filling_slot_by_slot(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 40)
    rows = [(i, "a" if i % 3 else "b") for i in range(700)] + [(1000 + i, None) for i in range(35)] + [(5, "a")] * 30
    frame = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    slots = {"a": 7, "b": 2, None: 1}
    mixed = M.mix(frame, slots=slots, block=10).toPandas()
    got = mixed.astype(object).where(mixed.notna(), None).groupby(["mix_slot", "source", "mix_block", "mix_round"], dropna=False).size()
    want = brute(rows, slots, 10)
    assert sorted((k[0], k[1] if isinstance(k[1], str) else None, k[2], k[3]) for k in got.index) == sorted(want)
    assert set(got[:-1]) <= {10, *[len([r for r in rows if r[1] == s]) % 10 for s in slots]}
    first_round = mixed[mixed.mix_round == 0]
    assert sorted(map(str, first_round.doc_id)) == sorted(str(i) for i, _ in rows)


def test_more_sources_than_slots_in_a_short_period(spark):
    rows = [(i, f"s{i % 1005}") for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    for slots in (None, {f"s{i}": 1 + i % 2 for i in range(1005)}):
        mixed = M.mix(frame, slots=slots, block=1)
        first = mixed.filter("mix_round = 0").select("doc_id", "source").collect()
        assert sorted((r.doc_id, r.source) for r in first) == rows
        assert mixed.select("mix_slot").distinct().count() == mixed.agg(F.max("mix_slot") + 1).first()[0]


def test_odd_rows(spark, docs):
    frame = docs([(1, None), (None, "x"), (2, ""), (2, "")])
    assert M.mix(frame).filter("mix_round = 0").count() == 4
    assert M.mix(frame.limit(0)).count() == 0
    assert M.mix(frame, slots={"nobody": 3}).count() == 0
    with pytest.raises(ValueError):
        M.mix(frame.withColumn("mix_slot", F.lit(1)))
    assert M.in_order(M.mix(frame)).count() >= 4


def test_given_documents(spark):
    frame = queries.table(spark, "/root/testdata/sf0.01", "documents")
    mixed = queries.mixed_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert set(mixed.doc_id) == {r.doc_id for r in frame.select("doc_id").collect()}
    counts = {M._plain(r[0]): r[1] for r in frame.groupBy("source").count().collect()}
    slots, period = M.smoothed(counts), M.PERIOD
    taken = mixed.drop_duplicates(["mix_slot"]).sort_values("mix_slot")
    assert list(taken.mix_slot) == list(range(len(taken)))
    done = dict.fromkeys(slots, 0)
    for t, source in enumerate(taken.source, 1):
        done[M._plain(source)] += 1
        assert all(abs(done[s] * period - slots[s] * t) < period for s in slots)

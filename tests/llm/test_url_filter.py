import datetime as dt

import pytest
from pyspark.sql import functions as F

from typelore.llm import url_filter as U


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def _events(spark, rows):
    return spark.createDataFrame([(p, None if d is None else day(d), a) for p, d, a in rows], "pattern string, at date, action string")


def test_intervals(spark, rows):
    events = [("a.b", 5, "add"), ("a.b", 5, "add"), ("a.b", 7, "add"), ("a.b", 9, "remove"), ("a.b", 9, "remove"),
              ("a.b", 12, "add"), ("c.d", 3, "remove"), ("c.d", 4, "add"), ("c.d", 4, "remove"), (None, 1, "add"),
              ("e.f", None, "add"), ("e.f", 2, "keep")]
    got = rows(U.intervals(_events(spark, events)))
    assert got == sorted([("a.b", day(5), day(9)), ("a.b", day(12), None), ("c.d", day(4), None)], key=repr)


@pytest.mark.parametrize(
    ("url", "patterns"),
    [
        ("https://u:p@A.b.C:8080/x//y?q=1#f", ["a.b.c", "a.b.c/x", "a.b.c/x/y", "b.c", "b.c/x", "b.c/x/y", "c", "c/x", "c/x/y"]),
        ("http://h.", ["h"]),
        ("no url", None),
        ("", None),
    ],
)
def test_patterns(spark, url, patterns):
    got = spark.createDataFrame([(url,)], "u string").select(U.patterns_of(F.col("u")).alias("p")).first().p
    assert got == patterns


def test_check_at_fetch_time(spark):
    valid = U.intervals(_events(spark, [("b.c", 5, "add"), ("b.c", 9, "remove"), ("a.b.c/x", 8, "add")]))
    captures = [(1, "http://a.b.c/x/y", 4), (2, "http://a.b.c/x/y", 5), (3, "http://a.b.c/x/y", 8), (4, "http://a.b.c/z", 9),
                (5, "http://xb.c/", 6), (6, None, 6), (7, "http://b.c", None), (8, "junk", 6), (3, "http://a.b.c/x/y", 8)]
    frame = spark.createDataFrame([(i, u, None if d is None else day(d), "keep") for i, u, d in captures],
                                  "id long, url string, fetched date, n string")
    got = U.check(frame, valid)
    assert got.columns == ["id", "url", "fetched", "n", "blocked", "pattern", "valid_from"]
    found = sorted((r.id, r.pattern) for r in got.collect() if r.blocked)
    assert found == [(2, "b.c"), (3, "a.b.c/x"), (3, "a.b.c/x")] and got.count() == len(captures)
    assert U.check(frame.limit(0), valid).count() == 0
    assert U.check(frame, valid.limit(0)).filter("blocked").count() == 0
    with pytest.raises(ValueError):
        U.check(frame.withColumn("blocked", F.lit(1)), valid)

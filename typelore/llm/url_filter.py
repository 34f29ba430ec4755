"""Dated URL lists: entries become validity intervals, captures are checked against what was listed when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typelore.session import cut_lineage


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from events (pattern, at, action), where action is ``add`` or ``remove``.

    A pattern is valid from an addition to the next removal; further additions in between change nothing, an open end is
    null. Of several events of a pattern at the same time an addition wins. Events with a null, or with another action,
    are left out. One row per pattern and time remains before events are put in order, so repeated events are cheap.
    """
    known = events.filter("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    dated = known.groupBy("pattern", "at").agg(F.max(F.col("action") == "add").alias("on"))
    by_time = Window.partitionBy("pattern").orderBy("at")
    changes = dated.withColumn("was", F.lag("on", 1, False).over(by_time)).filter("on <> was")
    ends = changes.withColumn("valid_to", F.lead("at").over(by_time))
    return ends.filter("on").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a last dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def patterns_of(url: Column) -> Column:
    """All patterns that list a URL: each end of its host from a dot on, alone and with each start of its path."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/+"), lambda p: p != "")
    paths = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.concat(F.when(n > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def check(captures: DataFrame, valid: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """Adds ``blocked`` and the longest pattern that was valid at the time (``pattern``, ``valid_from``; else null).

    Equal captures are checked once. They meet the intervals on the pattern, and the pair is kept where the time lies in
    the interval, which is at most one per pattern. Both sides come straight from written tables or rows, so a host with
    a third of all captures is split by adaptive execution. A null or unreadable URL and a null time are not blocked;
    repeated rows and other columns are kept as they are; an empty list blocks nothing.
    """
    clash = {"blocked", "pattern", "valid_from"} & set(captures.columns)
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
    listed = cut_lineage(valid.select(F.col("pattern").alias("_p"), "valid_from", "valid_to"), "intervals")
    asked = captures.select(F.col(url).alias("_u"), F.col(at).alias("_at")).filter("_u IS NOT NULL AND _at IS NOT NULL")
    keyed = asked.distinct().select("_u", "_at", F.explode(patterns_of(F.col("_u"))).alias("_p"))
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = keyed.join(listed, "_p").filter(active)
    found = met.groupBy("_u", "_at").agg(F.max(F.struct(F.length("_p").alias("n"), "_p", "valid_from")).alias("_hit"))
    same = (F.col(url) == F.col("_u")) & (F.col(at) == F.col("_at"))
    joined = captures.join(cut_lineage(found, "hits"), same, "left")
    return joined.select(
        *[captures[c] for c in captures.columns],
        F.col("_hit").isNotNull().alias("blocked"),
        F.col("_hit._p").alias("pattern"),
        F.col("_hit.valid_from").alias("valid_from"),
    )

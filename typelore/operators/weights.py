"""Term weights per group and their correlation with groups and with each other.

Weights are kept in long form (``group``, ``term``, weight); a missing row is a zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions.skew import HOT_ROWS, salted_join
from typelore.functions.top_n import first_n_per_group


def tf(counts: DataFrame) -> DataFrame:
    """Occurrences of words of two characters and more; takes the counts of ``term_counts``.

    Where these know the number of groups of a word, it is kept as ``df``.
    """
    known = [F.col("n_groups").alias("df")] if "n_groups" in counts.columns else []
    return counts.filter(F.length("token") >= 2).select(
        "group", F.col("token").alias("term"), F.col("occurrences").alias("tf"), *known
    )


def _idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _number_of_groups(rows: DataFrame) -> Column:
    return rows.agg(F.count_distinct("group")).scalar()


def df_idf(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups per term and smoothed inverse frequency, ``ln((1 + n) / (1 + df)) + 1``.

    ``n`` is the number of groups that ``groups`` names, those without any term included.
    """
    frequencies = counts.groupBy("term").agg(F.count("*").alias("df"))
    with_n = frequencies.withColumn("n", _number_of_groups(groups))
    return with_n.select("term", "df", _idf(F.col("df"), F.col("n")).alias("idf"))


def weigh_known(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``tf * idf`` of counts that bring ``df`` along: no join."""
    n = _number_of_groups(groups)
    weight = F.col("tf") * _idf(F.col("df"), F.col("n"))
    return counts.withColumn("n", n).select("group", "term", weight.alias("weight"))


def weigh(counts: DataFrame, idf: DataFrame, salts: int = 1, hot_df: int = HOT_ROWS) -> DataFrame:
    """``tf * idf``. ``salts`` spreads a term found in more than ``hot_df`` groups, which matters when the groups are
    persons. Such terms are read off ``idf`` if it has ``df``, and counted if not."""
    hot = idf.filter(F.col("df") > hot_df).select("term") if "df" in idf.columns else None
    joined = salted_join(counts, idf.select("term", "idf"), ["term"], "inner", salts, ["group"], hot)
    return joined.select("group", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def group_lengths(weights: DataFrame) -> DataFrame:
    """Euclidean length of each group's weights.

    An aggregation with partial sums: a window over the group would bring all terms of a group into one task.
    """
    return weights.groupBy("group").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))


def scale(weights: DataFrame, lengths: DataFrame) -> DataFrame:
    """Weights at length 1 per group."""
    scaled = (F.col("weight") / F.col("length")).alias("tfidf")
    return weights.join(lengths, "group").select("group", "term", scaled)


def tfidf(counts: DataFrame, groups: DataFrame, salts: int = 1) -> DataFrame:
    """Weights ``tf * idf`` scaled to length 1 per group.

    ``counts`` is read several times, so hand in a written table rather than the work that leads to it.
    ``plans.group_text.weighted_terms`` does the same with the parts in between written as well.
    """
    known = "df" in counts.columns
    weights = weigh_known(counts, groups) if known else weigh(counts, df_idf(counts, groups), salts)
    return scale(weights, group_lengths(weights))


def tfidf_matrix(weights: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Wide form for chosen terms: one row per group, ``group`` first, one column per term, zeros filled in."""
    wide = weights.groupBy("group").agg(
        *(F.sum(F.when(F.col("term") == t, F.col("tfidf")).otherwise(0.0)).alias(t) for t in terms)
    )
    return wide.select("group", *(f"`{t}`" for t in terms))


def _correlation(n: Column, sxy: Column, sx: Column, sy: Column, sxx: Column, syy: Column) -> Column:
    """Pearson's coefficient from sums; NULL for a column without spread."""
    spread_x = n * sxx - sx * sx
    spread_y = n * syy - sy * sy
    # what is left of a constant column after rounding is not a spread
    real = (spread_x > 1e-12 * n * sxx) & (spread_y > 1e-12 * n * syy)
    return F.when(real, F.try_divide(n * sxy - sx * sy, F.sqrt(spread_x) * F.sqrt(spread_y)))


def term_correlation(
    weights: DataFrame, terms: Sequence[str], groups: DataFrame | None = None, per_scan: int = 50
) -> DataFrame:
    """Correlation over groups of every term with each of the chosen ``terms``: ``term, other, correlation``.

    The chosen terms become one column each of a table with one row per group. Joined to the weights it gives all
    products of a term in one aggregation, so no pair of terms is ever a row before it is a result. Terms are handled
    ``per_scan`` at a time.
    """
    n = (weights if groups is None else groups).agg(F.count_distinct("group").cast("double")).scalar()
    terms = list(dict.fromkeys(terms))
    x = F.col("tfidf")
    parts = []
    for at in range(0, len(terms), per_scan):
        chosen = terms[at : at + per_scan]
        columns = [f"y{i}" for i in range(len(chosen))]
        listed = weights.filter(F.col("term").isin(chosen))
        wide = listed.groupBy("group").agg(
            *(F.sum(F.when(F.col("term") == t, x).otherwise(0.0)).alias(c) for t, c in zip(chosen, columns))
        )
        products = (
            weights.join(wide, "group", "left")
            .groupBy("term")
            .agg(
                F.sum(x).alias("sx"),
                F.sum(x * x).alias("sxx"),
                *(F.coalesce(F.sum(x * F.col(c)), F.lit(0.0)).alias(c) for c in columns),
            )
        )
        named = F.array(*(F.struct(F.lit(t).alias("other"), F.col(c).alias("sxy")) for t, c in zip(chosen, columns)))
        own = (
            listed.groupBy(F.col("term").alias("other"))
            .agg(F.sum(x).alias("sy"), F.sum(x * x).alias("syy"))
        )
        parts.append(
            products.select("term", "sx", "sxx", F.inline(named))
            .join(own, "other")
            .withColumn("n", n)
            .select(
                "term",
                "other",
                _correlation(*(F.col(c) for c in ("n", "sxy", "sx", "sy", "sxx", "syy"))).alias("correlation"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def group_indicators(groups: DataFrame) -> DataFrame:
    """One-hot columns of the groups in long form; all other cells are zero."""
    return groups.select("group").distinct().select("group", F.col("group").alias("indicator"), F.lit(1).alias("value"))


def _with_sums(weights: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Sums of each term over groups, with the number of groups."""
    n = (weights if groups is None else groups).agg(F.count_distinct("group").cast("double")).scalar()
    sums = weights.groupBy("term").agg(
        F.sum("tfidf").alias("sx"), F.sum(F.col("tfidf") * F.col("tfidf")).alias("sxx")
    )
    return sums.withColumn("n", n)


def _with_indicator(x: Column) -> Column:
    """Correlation with the indicator of one group, where the term weighs ``x``."""
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    return _correlation(n, x, sx, F.lit(1.0), sxx, F.lit(1.0))


def term_group_correlation_sparse(weights: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Correlation of each term with the groups it occurs in, and the one value it has with all other groups.

    A term weighs the same, nothing, in all groups without it, so one number per term stands for them. This form grows
    with the weights, however many groups there are.
    """
    sums = _with_sums(weights, groups)
    return weights.join(sums, "term").select(
        "term",
        "group",
        _with_indicator(F.col("tfidf")).alias("correlation"),
        _with_indicator(F.lit(0.0)).alias("correlation_elsewhere"),
    )


def term_group_correlation(
    weights: DataFrame, groups: DataFrame | None = None, ordered: bool = True
) -> DataFrame:
    """Correlation of every term with every group, ``term, group, correlation``, largest first if ``ordered``.

    For groups that are types and letters: a term's weights are gathered in a map of at most one entry per group, and
    the list of groups comes in as a scalar, so the grid is filled without a join.
    """
    named = (weights if groups is None else groups).filter(F.col("group").isNotNull())
    all_groups = named.agg(F.array_sort(F.collect_set("group"))).scalar()
    n = F.size("all_groups").cast("double")
    per_term = weights.groupBy("term").agg(
        F.sum("tfidf").alias("sx"),
        F.sum(F.col("tfidf") * F.col("tfidf")).alias("sxx"),
        F.map_from_entries(F.collect_list(F.struct("group", "tfidf"))).alias("by_group"),
    )
    grid = per_term.withColumn("all_groups", all_groups).select(
        "term", "sx", "sxx", "by_group", n.alias("n"), F.explode("all_groups").alias("group")
    )
    x = F.coalesce(F.try_element_at("by_group", F.col("group")), F.lit(0.0))
    correlation = grid.select("term", "group", _with_indicator(x).alias("correlation"))
    return correlation.orderBy(F.desc("correlation"), "term", "group") if ordered else correlation


def top_terms(correlation: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of each group with the largest correlation, with their rank."""
    order = [F.desc_nulls_last("correlation"), F.col("term")]
    return first_n_per_group(correlation, ["group"], order, k, rank_col="rank")

"""Statistics, vocabulary and weights of the groups people belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from typelore.functions import patterns as P
from typelore.operators import cleaning, groups, vocabulary, weights
from typelore.operators import people as people_ops
from typelore.session import cut_lineage


def group_summary(people: DataFrame) -> DataFrame:
    """Statistics per type and letter."""
    return groups.summary(people_ops.person_features(people))


def weighted_terms(counts: DataFrame, names: DataFrame, salts: int = 1) -> DataFrame:
    """Weights of counted terms, with group lengths, and idf where it has to be joined, written in between.

    ``names`` lists all groups (``groups.group_names``), as those without a term count for the idf as well. Nothing is
    computed twice, and Spark knows the size of both tables when it plans the joins: it broadcasts them if they are
    small and shuffles if not.
    """
    if "df" in counts.columns:
        weighted = weights.weigh_known(counts, names)
    else:
        weighted = weights.weigh(counts, cut_lineage(weights.df_idf(counts, names), "idf"), salts)
    return weights.scale(weighted, cut_lineage(weights.group_lengths(weighted), "lengths"))


def group_tfidf(
    people: DataFrame,
    grains: tuple[str, ...] = ("type", "letter"),
    lemmas: DataFrame | None = None,
    stopwords: Sequence[str] = P.STOPWORDS,
) -> DataFrame:
    """Term weights of each type and letter. The texts are read and cleaned once, for the counts, which are written."""
    tokens = cleaning.token_table(people, stopwords)
    counts = weights.tf(vocabulary.term_counts(tokens, grains, lemmas))
    return weighted_terms(cut_lineage(counts, "tf"), groups.group_names(people, grains))

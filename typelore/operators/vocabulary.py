"""Vocabulary, word counts and rare words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.operators.cleaning import lemmatize
from typelore.operators.groups import type_letter
from typelore.session import cut_lineage


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select("token").distinct()


def word_occurrences(tokens: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Occurrences per word, or per lemma, over the token rows given, or over words counted by ``count_words``.

    A word that makes up a large part of all text is counted within each map task first. Lemmas are looked up for the
    counted words, one row each, and what falls together is added up.
    """
    counted = count_words(tokens)
    return counted if lemmas is None else _by_lemma(counted, lemmas, [])


def count_words(tokens: DataFrame, *keys: str) -> DataFrame:
    """``keys, token, occurrences``, one row per word and values of ``keys``, null ones included; what is already counted
    by them is handed back.

    Written, it stands in for the token rows wherever only counts are wanted: the words for the lemmas and the counts
    themselves are then read off it, and the texts are cleaned once.
    """
    if "occurrences" in tokens.columns:
        return tokens.select(*keys, "token", "occurrences")
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("occurrences"))


def _by_lemma(counted: DataFrame, lemmas: DataFrame, keys: list[str]) -> DataFrame:
    return lemmatize(counted, lemmas).groupBy(*keys, "token").agg(F.sum("occurrences").alias("occurrences"))


def _by_lemma_apart(counted: DataFrame, lemmas: DataFrame, keys: list[str]) -> DataFrame:
    """The same for written counts: only words that are replaced, or that others are replaced by, are added up again.

    All other words keep their counts and are not shuffled, if the lemmas are small enough to be broadcast.
    """
    forms, bases = lemmas.select(F.col("form").alias("token")), lemmas.select(F.col("lemma").alias("token"))
    touched = cut_lineage(forms.union(bases).filter(F.col("token").isNotNull()).distinct(), "touched")
    same = counted.join(touched, "token", "left_anti").select(*keys, "token", "occurrences")
    return same.unionAll(_by_lemma(counted.join(touched, "token", "left_semi"), lemmas, keys).select(*same.columns))


def occurrence_histogram(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Words per interval of their number of occurrences: equal widths, the last interval closed, none left out.

    The words are first counted per number of occurrences; smallest and largest number come in as scalars.
    """
    sizes = counts.groupBy("occurrences").agg(F.count("*").alias("words"))
    low = counts.agg(F.min("occurrences").cast("double")).scalar()
    high = counts.agg(F.max("occurrences").cast("double")).scalar()
    # equal bounds are widened by one half on each side
    sizes = sizes.withColumn("_low", low).withColumn("_high", high)
    even = F.col("_low") == F.col("_high")
    sizes = sizes.withColumn("_from", F.when(even, F.col("_low") - 0.5).otherwise(F.col("_low"))).withColumn(
        "_to", F.when(even, F.col("_high") + 0.5).otherwise(F.col("_high"))
    )
    number = F.least(F.width_bucket(F.col("occurrences").cast("double"), F.col("_from"), F.col("_to"), F.lit(bins)), F.lit(bins))
    per_bin = sizes.withColumn("bin", number.cast("int")).groupBy("bin").agg(F.sum("words").alias("words"))
    all_bins = counts.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(per_bin, "bin", "left").select("bin", F.coalesce("words", F.lit(0)).alias("words"))


def rare_words(counts: DataFrame, min_occurrences: int = 2) -> DataFrame:
    return counts.filter(F.col("occurrences") < min_occurrences)


def rarity_summary(counts: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Number of rare words and their share of the vocabulary in percent, halves rounded to even."""
    rare = F.count_if(F.col("occurrences") < min_occurrences)
    share = F.try_divide(rare.cast("double"), F.count("*").cast("double")) * 100
    return counts.agg(rare.alias("rare_words"), F.bround(share, 0).cast("long").alias("percent"))


def remove_rare_words(tokens: DataFrame, rare: DataFrame) -> DataFrame:
    """Tokens that are not rare.

    ``rare`` grows with the vocabulary and is not broadcast beyond Spark's limit. Its words are first marked in a bit
    field of ``MARKS`` bits by hash, whose size has a bound and which is broadcast. A token whose bit is not set is no
    rare word and stays where it is; the few others are looked up in ``rare`` itself. Hand both in as written tables:
    ``tokens`` is read twice, and both sides of the join then come straight from their shuffles, so that adaptive
    execution splits the partition that a frequent word fills.
    """
    marks = rare.select(*_mark(F.col("token"))).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    marked = tokens.select("*", *_mark(F.col("token"))).join(F.broadcast(marks), "_word", "left")
    is_marked = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    unmarked = marked.filter(~is_marked).select(*tokens.columns)
    looked_up = marked.filter(is_marked).select(*tokens.columns).join(rare.select("token"), "token", "left_anti")
    return unmarked.unionAll(looked_up.select(*tokens.columns))


#: Bits in which words are marked, 64 to a row of the field: half a million rows at most.
MARKS = 2**25


def _mark(token: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(token), F.lit(MARKS))
    return F.floor(place / 64).alias("_word"), (place % 64).cast("int").alias("_bit")


def term_counts(
    tokens: DataFrame, grains: tuple[str, ...] = ("type", "letter"), lemmas: DataFrame | None = None
) -> DataFrame:
    """Occurrences of each word in each group, and the number of groups it occurs in.

    The words are counted per type first. What is left of a word, one row per type, is then gathered in one array with
    its totals per letter: at most 81 types and 8 letters. The array's size is the number of groups, so later steps do
    not have to find and join it. For ``("person",)`` the groups are not bounded, and the number is left out. With
    ``lemmas`` the counted words are replaced and added up once more. In place of the token rows, words counted by
    ``count_words`` per type, or person, will do.
    """
    replace = _by_lemma_apart if "occurrences" in tokens.columns else _by_lemma
    if grains == ("person",):
        counted = count_words(tokens, "person_id").withColumnRenamed("person_id", "group")
        if lemmas is None:
            return counted
        return replace(counted, lemmas, ["group"])
    per_type = count_words(tokens.filter(F.col("type").isNotNull()), "type")
    if lemmas is not None:
        per_type = replace(per_type, lemmas, ["type"])
    gathered, parts = [], []
    if "type" in grains:
        gathered.append(F.collect_list(F.struct(F.col("type").alias("group"), "occurrences")).alias("types"))
        parts.append(F.col("types"))
    if "letter" in grains:
        letters = []
        for _, one, zero, at in P.DICHOTOMIES:
            for name in (one, zero):
                in_group = type_letter("type", at, one, zero) == name
                gathered.append(F.sum(F.when(in_group, F.col("occurrences"))).alias(name))
                total = F.struct(F.lit(name).alias("group"), F.col(name).alias("occurrences"))
                letters.append(F.when(F.col(name).isNotNull(), total))
        parts.append(F.array_compact(F.array(*letters)))
    by_word = per_type.groupBy("token").agg(*gathered).select("token", F.concat(*parts).alias("groups"))
    # the outer form, as else Spark builds the arrays once more to look for empty ones
    return by_word.select("token", F.size("groups").alias("n_groups"), F.inline_outer("groups")).select(
        "group", "token", "occurrences", "n_groups"
    )


def stats_and_tokens(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Statistics of each group beside the occurrences of its words, one row per word.

    ``stats`` has one row per group. Handed in as a written table its size is known, and it is broadcast.
    """
    return counts.join(stats, "group").select(*stats.columns, "token", "occurrences")


def person_stats_and_tokens(features: DataFrame, tokens: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Counts and means of each person beside the occurrences of their words, one row per word.

    The people, a short row each, are hashed per partition, so that the many more words need not be sorted for the join.
    """
    counts = term_counts(tokens, ("person",), lemmas).withColumnRenamed("group", "person_id")
    kept = ["person_id", "type", "posts_count", *(c for c in features.columns if c.startswith("mean_"))]
    return counts.join(features.select(*kept).hint("shuffle_hash"), "person_id").select(*kept, "token", "occurrences")

"""From posts to cleaned text and to the token table that vocabulary and weights are built on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.functions import text as X
from typelore.operators.groups import groups_of_type, posts_table

TOKEN_COLUMNS = ("person_id", "type", "post_no", "pos", "token")


def clean_posts(posts: DataFrame) -> DataFrame:
    """Posts with their cleaned text."""
    return posts.withColumn("cleaned", X.clean_text(F.col("post")))


def _words(post: Column) -> Column:
    """Words of a post as an array; same result as cleaning and tokenizing step by step.

    The words are picked out of the text directly, so the steps that only turn other characters into single blanks are
    left out.
    """
    lowered = F.lower(X.remove_punctuation(X.remove_emojis(X.remove_urls(post))))
    return X.tokenize(X.remove_digits(lowered))


def token_table(
    people: DataFrame, stopwords: Sequence[str] = P.STOPWORDS, lemmas: DataFrame | None = None
) -> DataFrame:
    """One row per word of every post, without stopwords: ``person_id, type, post_no, pos, token``.

    Posts are cleaned one by one and never as part of a group: no pattern reaches across the blank between two posts,
    and each text is cleaned once instead of once per group it counts for. No shuffle is needed.
    """
    tokens = remove_stopwords(tokenize_posts(posts_table(people)), stopwords)
    return tokens if lemmas is None else lemmatize(tokens, lemmas)


def tokenize_posts(posts: DataFrame) -> DataFrame:
    """One row per word, stopwords included; ``pos`` counts the words of a post.

    The outer form again keeps Spark from cleaning each text twice.
    """
    words = F.posexplode_outer(_words(F.col("post"))).alias("pos", "token")
    return posts.select("person_id", "type", "post_no", words).filter(F.col("token").isNotNull())


def remove_stopwords(tokens: DataFrame, stopwords: Sequence[str] = P.STOPWORDS) -> DataFrame:
    """The list is part of the expression: a hash lookup in generated code, no join."""
    return tokens.filter(~F.col("token").isin(list(stopwords)))


def lemmatize(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replaces a token by its lemma; ``lemmas`` has one row (``form``, ``lemma``) per form.

    Spark broadcasts the lemmas if they are small. If not, hand them in as a written table: both sides then come straight
    from their shuffles, and adaptive execution splits the partition that a frequent word fills. Where only counts are
    wanted, count first and replace the counted words, as ``word_occurrences`` and ``term_counts`` do.
    """
    columns = [c for c in tokens.columns if c != "token"]
    joined = tokens.join(lemmas.withColumnRenamed("form", "token"), "token", "left")
    return joined.select(*columns, F.coalesce("lemma", "token").alias("token")).select(*tokens.columns)


def changing(lemmas: DataFrame) -> DataFrame:
    """The rows of a lemma table that replace something. A table of ``noun_lemmas`` lists every known word, most of
    them as their own lemma; with one row per form, as there, ``lemmatize`` does the same with these rows alone. Written,
    they are as a rule small enough to be broadcast, and token rows are not shuffled."""
    return lemmas.filter(F.col("form") != F.col("lemma"))


def with_noun_ending(forms: DataFrame) -> DataFrame:
    """The words (column ``token``) that ``noun_lemmas`` may change: without exceptions, a word that has none of the noun
    endings can only become itself."""
    return forms.filter(reduce(or_, (F.col("token").endswith(end) for end, _ in P.NOUN_ENDINGS)))


def _with_ending_replaced(forms: Column, ending: str, new: str) -> Column:
    ended = F.filter(forms, lambda w: w.endswith(ending))
    return F.transform(ended, lambda w: F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(new)))


def _shortened(forms: Column) -> Column:
    """All results of replacing one noun ending, in order, without copies."""
    return F.array_distinct(F.concat(*(_with_ending_replaced(forms, end, new) for end, new in P.NOUN_ENDINGS)))


def noun_lemmas(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Lemma table (``form``, ``lemma``) for the distinct words in ``forms`` (column ``token``).

    A word listed in ``exceptions`` (``form``, ``base``) can only become itself or a listed base. For any other word
    the noun endings are replaced, over and over until none is left. Of the candidates known to ``lexicon`` (column
    ``word``) the first replacement that yields any counts, and of these the shortest. Words without a known candidate
    get no row, and keep their form.
    """
    distinct = forms.select(F.col("token").alias("form")).distinct()
    known = lexicon.select(F.col("word").alias("lemma")).distinct()
    if exceptions is None:
        distinct = distinct.withColumn("bases", F.lit(None).cast("array<string>"))
    else:
        listed = exceptions.groupBy("form").agg(F.array_sort(F.collect_set("base")).alias("bases"))
        distinct = distinct.join(listed, "form", "left")

    form = F.col("form")
    first = F.array_compact(
        F.array(
            *(
                F.when(form.endswith(end), F.concat(F.substring(form, F.lit(1), F.length(form) - len(end)), F.lit(new)))
                for end, new in P.NOUN_ENDINGS
            )
        )
    )
    further = F.aggregate(
        F.sequence(F.lit(1), F.length(form)),
        F.struct(_shortened(first).alias("last"), F.array().cast("array<array<string>>").alias("rounds")),
        lambda acc, _: F.when(F.size(acc["last"]) == 0, acc).otherwise(
            F.struct(
                _shortened(acc["last"]).alias("last"),
                F.concat(acc["rounds"], F.array(acc["last"])).alias("rounds"),
            )
        ),
        lambda acc: acc["rounds"],
    )
    # one replacement leaves a further ending only in words such as glasses, moss or yeomens
    repeats = form.rlike("(ss|ses|mens)$")
    start = F.array(F.concat(F.array(form), first))
    candidates = distinct.select(
        "form",
        F.when(F.col("bases").isNotNull(), F.array(F.concat(F.array(form), F.col("bases"))))
        .when(repeats, F.concat(start, further))
        .otherwise(start)
        .alias("rounds"),
    )
    # the outer forms, as else Spark computes the candidates once more to look for empty arrays
    ranked = candidates.select("form", F.posexplode_outer("rounds").alias("round", "found")).select(
        "form", "round", F.posexplode_outer("found").alias("place", "lemma")
    )
    order = F.struct("round", F.length("lemma"), "place")
    return ranked.join(known, "lemma", "left_semi").groupBy("form").agg(F.min_by("lemma", order).alias("lemma"))


def clean_preview(
    people: DataFrame, group: str, n: int = 174, stopwords: Sequence[str] = P.STOPWORDS, lemmas: DataFrame | None = None
) -> DataFrame:
    """Tokens, lemmatised if ``lemmas`` are given, of the first ``n`` characters of a group's text.

    Every post but the first adds at least the blank before it, so the first ``n`` + 1 posts hold ``n`` characters.
    """
    posts = posts_table(people).filter(F.array_contains(groups_of_type("type"), group))
    first = posts.orderBy("person_id", "post_no").limit(n + 1)
    ordered = F.array_sort(F.collect_list(F.struct("person_id", "post_no", "post")))
    text = F.array_join(F.transform(ordered, lambda p: p["post"]), " ")
    shown = first.agg(F.substring(text, 1, n).alias("example")).withColumn(
        "tokens", X.clean_tokens(F.col("example"), stopwords)
    )
    if lemmas is None:
        return shown
    placed = lemmatize(shown.select("example", F.posexplode_outer("tokens").alias("pos", "token")), lemmas)
    again = placed.groupBy("example").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("placed"))
    return again.select("example", F.array_compact(F.transform("placed", lambda p: p["token"])).alias("tokens"))


def group_tokens(tokens: DataFrame, grains: tuple[str, ...] = ("type", "letter")) -> DataFrame:
    """Tokens of each group, as rows: every group holds all words of its people. Lemmatise the tokens before."""
    return tokens.filter(F.col("type").isNotNull()).select(
        F.explode(groups_of_type("type", grains)).alias("group"), "person_id", "post_no", "pos", "token"
    )

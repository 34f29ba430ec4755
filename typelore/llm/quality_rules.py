"""Quality rules as a ledger: every rule is evaluated once per document, policies are bit masks over the outcome."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typelore.llm.expressions import WHITE, count_of, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """A rule fails where ``fails`` holds for the measurements; its place in the list of rules is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("exclamations", "10 * n_exclamations > word_chars"),
)

#: Sets of rules by version; a new version is a new mask over the same ledger.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "2": tuple(rule.name for rule in RULES),
}


def _repeated_words(tokens: Column) -> Column:
    """Words within windows of eight words that occur at least twice in ``tokens``."""

    def joined(hashes: Column, step: int) -> Column:
        firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - step, F.lit(0)))
        return F.transform(firsts, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def again(pairs: Column) -> Column:
            same = F.filter(
                pairs,
                lambda e, i: (e["h"] == F.get(pairs, i - 1)["h"]) | (e["h"] == F.get(pairs, i + 1)["h"]),
            )
            return F.sort_array(F.transform(same, lambda e: e["at"]))

        def total(at: Column) -> Column:
            each = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(each, F.lit(0), lambda a, x: a + x)

        return let(placed, lambda pairs: let(again(pairs), total))

    eights = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda one: let(joined(one, 1), lambda two: let(joined(two, 2), lambda four: joined(four, 4))),
    )
    return let(
        eights, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    )


def _lines(text: Column) -> Column:
    """Number of lines that hold a word, and how many of them equal an earlier one."""
    written = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    return let(
        written, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``measures`` of longs. A null text has no words. Needs no shuffle and no other row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("again")))
    found = df.withColumns({"_words": counted, "_lines": _lines(whole)})
    return found.withColumn(
        "measures",
        F.struct(
            F.col("_words.n").cast("long").alias("n_words"),
            F.char_length(F.translate(whole, WHITE, "")).cast("long").alias("word_chars"),
            count_of(whole, SYMBOLS).alias("n_symbols"),
            F.col("_lines.n").cast("long").alias("n_lines"),
            F.col("_lines.again").cast("long").alias("n_dup_lines"),
            F.col("_words.again").cast("long").alias("n_repeat_words"),
            count_of(whole, string.ascii_uppercase).alias("n_capitals"),
            count_of(whole, "!").alias("n_exclamations"),
        ),
    ).drop("_words", "_lines")


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``measures`` and ``failed`` (long, one bit per rule) to whole texts and keeps all other columns.

    The ledger is what to store: policies, their versions and ablations need no text any more. A null or empty text
    has no words and so fails ``few_words``; repeated rows get the same bits.
    """
    if len(rules) > 62 or len({rule.name for rule in rules}) < len(rules):
        raise ValueError("at most 62 rules with different names")
    clash = {"measures", "failed", "_words", "_lines"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already exist: {sorted(clash)}")
    measured = measure(df, text)
    # the rules see the measurements only, whatever other columns are called
    fields = measured.schema["measures"].dataType.fieldNames()
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(rules):
        condition = rule.fails
        for field in sorted(fields, key=len, reverse=True):
            condition = _qualified(condition, field)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", bits)


def _qualified(condition: str, field: str) -> str:
    return " ".join(f"measures.{field}" if token == field else token for token in condition.split())


def mask(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    names = [rule.name for rule in rules]
    return sum(1 << names.index(name) for name in policy)


def passes(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(entries: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that are kept without it.

    One aggregation over the bits: documents are first counted by the failed rules of the policy, which leaves at most
    two to the power of the rules rows.
    """
    own = F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    counted = entries.groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n], rules)).cast("long").alias("bit")) for n in policy])
    )
    each = counted.select("bits", "n", named.alias("r")).select("bits", "n", "r.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )

"""Column expressions on text. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from typelore.functions import patterns as P


def unbold(text: Column) -> Column:
    """Mathematical bold capitals become plain capitals, everything else stays."""
    return F.translate(text, P.BOLD_CAPITALS, P.CAPITALS)


def first_match(text: Column, pattern: str, group: int) -> Column:
    """Text of ``group`` in the first match, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


# ---- cleaning steps, in the order they are applied ---------------------------------------------------------------


def remove_urls(text: Column) -> Column:
    return remove(text, P.URL)


def remove_emojis(text: Column, mode: str = "effective") -> Column:
    return remove(text, P.EMOJI[mode])


def remove_punctuation(text: Column) -> Column:
    """No blank is left behind: ``well-known`` becomes ``wellknown``."""
    return remove(text, P.PUNCTUATION)


def special_to_blank(text: Column) -> Column:
    """Everything but letters and digits of any script becomes a blank."""
    return F.regexp_replace(text, f"[^{P.WORD_CHAR}]", " ")


def remove_digits(text: Column) -> Column:
    return remove(text, "[0-9]")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{P.BLANK_CHAR}]+", " ")


def clean_text(text: Column, emoji_mode: str = "effective") -> Column:
    """Lower-case words separated by single blanks."""
    text = remove_urls(text)
    text = remove_emojis(text, emoji_mode)
    text = F.lower(remove_punctuation(text))
    text = remove_digits(special_to_blank(text))
    return F.trim(collapse_blanks(text))


def _word_pattern() -> str:
    """A run of letters and digits, but only the first half of a contraction: the second is then the next match."""
    end = f"(?![{P.WORD_CHAR}])"
    halves = "|".join(f"{head}(?={tail}{end})" for head, tail in P.CONTRACTIONS)
    return f"(?:{halves}|[{P.WORD_CHAR}]+)"


def tokenize(text: Column) -> Column:
    """Words of a cleaned text as array; ``cannot`` and its like are two words."""
    return F.regexp_extract_all(text, F.lit(_word_pattern()), F.lit(0))


def without_stopwords(tokens: Column, stopwords: Sequence[str] = P.STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stopwords)))


def clean_tokens(text: Column, stopwords: Sequence[str] = P.STOPWORDS) -> Column:
    """Array of the words of ``text``, stopwords removed."""
    return without_stopwords(tokenize(clean_text(text)), stopwords)


# ---- comments --------------------------------------------------------------------------------------------------------


def tidy_comment(text: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Comment without quoted lines, poll links and URLs, with abbreviations written out.

    The abbreviations are a small driver-side list; each one is replaced where it stands as a whole word.
    """
    text = remove(text, P.QUOTED_LINE)
    text = remove(text, P.VIEW_POLL)
    text = remove_urls(text)
    for short, full in (P.ABBREVIATIONS if abbreviations is None else abbreviations).items():
        word = rf"(?<![{P.WORD_CHAR}_])\Q{short}\E(?![{P.WORD_CHAR}_])"
        text = F.regexp_replace(text, word, full.replace("\\", "\\\\").replace("$", r"\$"))
    return text

"""Column helpers of the operators that use DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters between words.
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    spaces = F.translate(text, WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaces, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")

"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text itself, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of the whole text as long; null counts as empty.

    Each word becomes one letter and blanks go, which holds no array of words.
    """
    return F.length(F.translate(F.regexp_replace(whole(text), WORD, "w"), " \t\n\x0b\x0c\r", "")).cast("long")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

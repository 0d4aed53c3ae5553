"""Pattern matching on text. Patterns stay free of lookaround, so they run in linear-time engines too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any pattern, as one alternation per call."""
    return value.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def group_of(value: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, or NULL when nothing matches."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))


def all_groups(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def last_part(value: Column, separator_pattern: str = "\\|") -> Column:
    return F.element_at(F.split(value, separator_pattern), -1)

"""Value mapping, ratios, class probabilities and reproducible pseudo-random numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def map_values(value: Column, mapping: Mapping, default=None) -> Column:
    """Look ``value`` up in a small literal mapping; ``default`` where it has no entry."""
    items = list(mapping.items())
    chain = F.when(value == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, result in items[1:]:
        chain = chain.when(value == F.lit(key), F.lit(result))
    return chain if default is None else chain.otherwise(F.lit(default))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def at_least(value: Column, lower) -> Column:
    return F.greatest(value, F.lit(lower))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(condition: Column) -> Column:
    """0/1 flag in which an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def dominant_side(n_gov: Column, n_opo: Column) -> Column:
    return (
        F.when((n_gov > 0) & (n_opo > 0), "mixed")
        .when(n_gov > 0, "gov").when(n_opo > 0, "opo").otherwise("unmapped_only")
    )


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Row-wise softmax, shifted by the row maximum so that it cannot overflow."""
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def top_class(scores: Sequence[Column], names: Sequence[str]) -> Column:
    """Name of the highest score; the earliest name wins a tie."""
    top = F.greatest(*scores)
    chain = F.when(scores[0] == top, names[0])
    for score, name in zip(scores[1:], names[1:]):
        chain = chain.when(score == top, name)
    return chain


HASH_RANGE = 1 << 52


def hash_number(*parts: Column) -> Column:
    """Whole number in [0, 2^52) that depends only on ``parts``: a seedable, order-free draw."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_uniform(*parts: Column) -> Column:
    return hash_number(*parts) / F.lit(float(HASH_RANGE))

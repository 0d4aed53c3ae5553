"""Majority votes of point labels per cell and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from celltide import fixed_values as fixed
from celltide.schemas import KEY


def priority_of(label: Column, priority: Sequence[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), label)
    return F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))


def majority_vote(
    points: DataFrame, label: str = "control_status", confidence: str = "confidence",
    keys: Sequence[str] = KEY, priority: Sequence[str] = fixed.LABEL_STATUSES,
) -> DataFrame:
    """Winning label, its confidence class, the votes and the high-confidence votes of each group.

    Votes are counted per label before groups are compared, so a hot group reaches the last step
    as one row per label. Ties go to the earlier label of ``priority``, then alphabetically.
    """
    known = points.filter(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, label]))
    ballots = known.groupBy(*keys, label).agg(
        F.count("*").alias("votes"), F.count_if(F.col(confidence) == "high").alias("high"),
    )
    place = priority_of(F.col(label), priority)
    winner = F.min_by(label, F.struct(-F.col("votes"), place, label))
    share = F.max("votes") / F.sum("votes")
    return ballots.groupBy(*keys).agg(
        winner.alias(label),
        F.when(share >= 0.75, "high").when(share >= 0.5, "medium").otherwise("low").alias("label_confidence"),
        F.sum("votes").alias("n_towns_in_cell"),
        F.sum("high").alias("high_conf_towns"),
    )

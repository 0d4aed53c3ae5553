"""Actor classification by ordered patterns, type fallback and dated overrides.

Rules are a user-supplied list: they become one CASE expression that runs inside the scan's
stage, so no pair of actor and rule is ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from celltide import fixed_values as fixed
from celltide.functions import text


@dataclass(frozen=True)
class ActorRule:
    patterns: tuple[str, ...]
    side: str
    coalition: str
    actor_group: str


def read_actor_rules(spark: SparkSession, path: str) -> list[ActorRule]:
    """Rules from a CSV of ``rule_id, pattern, side, coalition, actor_group``, one line per pattern."""
    rows = (
        spark.read.option("header", True).option("escape", '"').csv(path)
        .select(F.col("rule_id").cast("int").alias("rule_id"), "pattern", "side", "coalition", "actor_group")
        .collect()  # a list that users write
    )
    grouped: dict[int, list] = {}
    for row in rows:
        grouped.setdefault(row["rule_id"], []).append(row)
    return [
        ActorRule(tuple(r["pattern"] for r in g), g[0]["side"], g[0]["coalition"], g[0]["actor_group"])
        for _, g in sorted(grouped.items())
    ]


def _outcome(side: str, coalition: str, group: str) -> Column:
    return F.struct(
        F.lit(side).alias("side"), F.lit(coalition).alias("coalition"), F.lit(group).alias("actor_group")
    )


def match_actor(actor: Column, rules: Sequence[ActorRule]) -> Column:
    """Outcome of the first rule that matches, NULL when none does or the actor is unknown."""
    chain = None
    for rule in rules:
        hit = text.matches_any(actor, rule.patterns)
        result = _outcome(rule.side, rule.coalition, rule.actor_group)
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    return chain


def fallback_outcome(kind: Column, fallback: Mapping[str, tuple] = fixed.TYPE_FALLBACK,
                     unmatched: tuple = fixed.UNMATCHED_ACTOR) -> Column:
    chain = None
    for name, outcome in fallback.items():
        hit = kind == F.lit(name)
        chain = F.when(hit, _outcome(*outcome)) if chain is None else chain.when(hit, _outcome(*outcome))
    other = _outcome(*unmatched)
    return other if chain is None else chain.otherwise(other)


def apply_overrides(df: DataFrame, actor: str, date: str, overrides=fixed.TIME_OVERRIDES) -> DataFrame:
    """Replace outcomes of a group after (inclusive) or before (exclusive) a date, rule by rule."""
    for group, direction, cutoff, outcome in overrides:
        day = F.lit(cutoff).cast("date")
        when = F.col(date) >= day if direction == "after" else F.col(date) < day
        hit = (F.col(f"{actor}.actor_group") == group) & when
        df = df.withColumn(actor, F.when(hit, _outcome(*outcome)).otherwise(F.col(actor)))
    return df


def classify_actors(
    df: DataFrame, rules: Sequence[ActorRule], actor: str = "actor1", kind: str = "inter1",
    date: str = "event_date", fallback: Mapping[str, tuple] = fixed.TYPE_FALLBACK,
    overrides=fixed.TIME_OVERRIDES, unmatched: tuple = fixed.UNMATCHED_ACTOR,
) -> DataFrame:
    """Add side, coalition and actor_group to every row. Map-only: no shuffle, no join."""
    matched = df.withColumn("_matched", match_actor(F.col(actor), rules))
    resolved = matched.withColumn(
        "_actor", F.coalesce("_matched", fallback_outcome(F.col(kind), fallback, unmatched))
    )
    final = apply_overrides(resolved, "_actor", date, overrides)
    return final.select(*df.columns, "_actor.side", "_actor.coalition", "_actor.actor_group")


def override_window(date: Column, overrides=fixed.TIME_OVERRIDES) -> Column:
    """Number of cutoffs at or before the date: rows with equal numbers get equal overrides."""
    cutoffs = sorted({cutoff for _, _, cutoff, _ in overrides})
    total = F.lit(0)
    for cutoff in cutoffs:
        total = total + F.coalesce((date >= F.lit(cutoff).cast("date")).cast("int"), F.lit(0))
    return total

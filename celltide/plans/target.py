"""Signals per cell-month, agreement of two sources, and the target cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from celltide import fixed_values as fixed
from celltide.functions import dates, grid
from celltide.functions.values import dominant_side, map_values, percent
from celltide.operators.actors import ActorRule, classify_actors, override_window
from celltide.operators.keys import flag_members
from celltide.operators.panel import changed_nearby
from celltide.operators.summaries import breakdown, frequency
from celltide.schemas import CELL, CLASSES, KEY, PERIOD, SLIM_TARGET_COLUMNS, TARGET_COLUMNS


def control_signals(
    events: DataFrame, types: Sequence[str] = fixed.CONTROL_SIGNAL_TYPES, since: str = fixed.EVENTS_SINCE,
    keep: Column | None = None,
) -> DataFrame:
    """Control-signal events since a day that ``keep`` holds for (e.g. one country), with their cell."""
    events = events if keep is None else events.filter(keep)
    flagged = flag_members(events, F.col("sub_event_type"), types, "is_control_signal")
    kept = flagged.filter(F.col("is_control_signal") & (F.col("event_date") >= F.lit(since).cast("date")))
    return kept.withColumn(CELL, grid.cell_id(F.col("latitude"), F.col("longitude")))


def signals_to_panel(
    events: DataFrame, rules: Sequence[ActorRule], types: Sequence[str] = fixed.CONTROL_SIGNAL_TYPES,
    since: str = fixed.EVENTS_SINCE, sides: Mapping[str, str] = fixed.ACTOR_SIDES,
    keep: Column | None = None, **classify,
) -> DataFrame:
    """Signals by side per cell-month.

    Events are counted per actor, type and override period before any pattern is tried, so each
    pattern runs once per distinct combination and a hot cell is reduced before it is shuffled.
    """
    window = override_window(F.col("event_date"), classify.get("overrides", fixed.TIME_OVERRIDES))
    located = control_signals(events, types, since, keep).filter(F.col(CELL).isNotNull()).withColumns({
        "_month": F.trunc("event_date", "month"), "_window": window,
    })
    reduced = located.groupBy(CELL, "_month", "actor1", "inter1", "admin1", "_window").agg(
        F.count("*").alias("_n"), F.count("event_id_cnty").alias("_ids"), F.min("event_date").alias("event_date"))
    named = classify_actors(reduced, rules, **classify)
    side = map_values(F.col("side"), sides, "unmapped")
    n = lambda name: F.coalesce(F.sum(F.when(F.col("_side") == name, F.col("_n"))), F.lit(0))
    counts = named.withColumn("_side", side).groupBy(CELL, "_month").agg(
        n("gov").alias("n_gov"), n("opo").alias("n_opo"), n("unmapped").alias("n_unmapped"),
        F.sum("_ids").alias("total_ctrl_evs"),
        F.min_by("admin1", F.when(F.col("admin1").isNotNull(), F.struct("event_date", "admin1"))).alias("admin1"),
    )
    return counts.select(
        CELL, dates.month_of(F.col("_month")).alias(PERIOD), "n_gov", "n_opo", "n_unmapped", "total_ctrl_evs", "admin1",
        dominant_side(F.col("n_gov"), F.col("n_opo")).alias("acled_side"))


def agreement(signal: Column, label: Column, default: str) -> Column:
    """How a signal side and a label side relate; ``default`` where there is nothing to compare."""
    clear = signal.isin("gov", "opo") & label.isNotNull()
    return (
        F.when(signal == "mixed", "acled_mixed")
        .when(clear & (label == "contested"), "wiki_contested")
        .when(clear & (signal == label), "agree")
        .when(clear, "disagree")
        .otherwise(default)
    )


def compare_signals(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """Signals with the label of their cell-month and their agreement ('no_info' without a clear pair)."""
    named = labels.select(*KEY, "control_status", map_values(F.col("control_status"), fixed.STATUS_SIDES).alias("wiki_side"))
    joined = signals.join(named, KEY, "left")
    return joined.withColumn("agreement", agreement(F.col("acled_side"), F.col("wiki_side"), "no_info"))


def fuse_target(df: DataFrame) -> DataFrame:
    """Add target and reason from wiki_side, acled_side, agreement and wiki_changed_recent."""
    how, signal = F.col("agreement"), F.col("acled_side")
    from_label = map_values(F.col("wiki_side"), fixed.SIDE_TARGETS)
    recent = F.col("wiki_changed_recent")
    return df.withColumns({
        "target": F.when(how == "wiki_only", from_label)
            .when(how.isin("agree", "wiki_contested"), signal)
            .when((how == "disagree") & recent, from_label)
            .when(how == "disagree", signal)
            .when(how == "acled_mixed", "uncertain"),
        "reason": F.when(how == "wiki_contested", "wiki_contested_use_acled")
            .when((how == "disagree") & recent, "disagree_recent_wiki_use_wiki")
            .when(how == "disagree", "disagree_stable_wiki_use_acled")
            .otherwise(how),
    })


def build_target(labels: DataFrame, signals: DataFrame, boundary: str = "changed") -> DataFrame:
    """Target panel on the label panel's rows; change flags are computed before the join, per cell."""
    base = labels.select(*KEY, "control_status").withColumns({
        "wiki_side": map_values(F.col("control_status"), fixed.STATUS_SIDES),
        "wiki_changed_recent": changed_nearby("control_status", boundary),
    })
    counts = ["n_gov", "n_opo", "n_unmapped", "total_ctrl_evs"]
    joined = base.join(signals.select(*KEY, *counts, "admin1", "acled_side"), KEY, "left")
    filled = joined.fillna(0, subset=counts).fillna({"acled_side": "none", "admin1": ""})
    compared = filled.withColumn("agreement", agreement(F.col("acled_side"), F.col("wiki_side"), "wiki_only"))
    return fuse_target(compared).select(*TARGET_COLUMNS)


def check_target(target: DataFrame) -> DataFrame:
    """Violations of each invariant, as (check, n_bad); all zero for a sound target."""
    t, r = F.col("target"), F.col("reason")
    checks = {
        "target_not_null": t.isNull(), "reason_not_null": r.isNull(),
        "agree_means_equal_sides": (r == "agree") & ~F.col("acled_side").eqNullSafe(F.col("wiki_side")),
        "target_domain": t.isNotNull() & ~t.isin(list(CLASSES)),
    }
    counted = target.agg(*[F.count_if(c).alias(n) for n, c in checks.items()],
                         (F.count("*") - F.count("reason")).alias("reasons_sum_to_rows"))
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in [*checks, "reasons_sum_to_rows"]])))


def require_sound(target: DataFrame) -> None:
    failed = check_target(target).filter("n_bad > 0").first()
    if failed is not None:
        raise ValueError(f"target check failed: {failed.asDict()}")


def summarize_target(target: DataFrame) -> DataFrame:
    """Rows and percentage by target, by reason, and by whether a usable signal exists."""
    pieces = F.explode(F.array(
        F.struct(F.lit("target").alias("part"), F.col("target").alias("value")),
        F.struct(F.lit("reason").alias("part"), F.col("reason").alias("value")),
        F.struct(F.lit("source").alias("part"),
                 F.when(F.col("agreement") == "wiki_only", "label_only").otherwise("with_signal").alias("value")),
    )).alias("p")
    counts = target.select(pieces).select("p.*").groupBy("part", "value").agg(F.count("*").alias("n"))
    total = counts.filter("part = 'reason'").agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("_total", total).select(
        "part", "value", "n", percent(F.col("n"), F.col("_total")).alias("pct"))


def reason_breakdown(target: DataFrame) -> DataFrame:
    return breakdown(target, "reason", "target")


def slim_target(target: DataFrame) -> DataFrame:
    return target.select(*SLIM_TARGET_COLUMNS)


def target_shares(target: DataFrame) -> DataFrame:
    return frequency(target, "target")

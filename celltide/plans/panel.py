"""Dense cell-month panel, covariates and the feature store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from celltide import fixed_values as fixed
from celltide.functions import dates
from celltide.functions.values import flag, safe_ratio
from celltide.operators import panel as ops
from celltide.operators.keys import left_enrich
from celltide.runtime import checkpoint
from celltide.schemas import CELL, PERIOD
from celltide.sources.readers import normalize_key, scan_columns


def filter_precision(events: DataFrame, maximum: int = fixed.MAX_WHERE_PRECISION) -> DataFrame:
    """Events located precisely enough; an unknown precision is dropped."""
    return events.filter(F.col("where_prec") <= maximum)


def presence_flags(
    events: DataFrame, actors: Mapping[str, str], sides: Sequence[str] = ("side_a_level3", "side_b_level3"),
) -> DataFrame:
    """1 where the actor's code stands on either side."""
    a, b = sides
    return events.withColumns({
        name: flag(F.coalesce(F.col(a) == code, F.lit(False)) | F.coalesce(F.col(b) == code, F.lit(False)))
        for name, code in actors.items()
    })


def violence_flags(events: DataFrame, government: str, side: str = "side_a_level3") -> DataFrame:
    kind = F.col("type_of_violence")
    return events.withColumns({
        "is_onesided": flag(kind == 3), "is_statebased": flag(kind == 1),
        "gov_vs_civilians": flag((F.col(side) == government) & (kind == 3)),
    })


def cell_months(events: DataFrame, actors: Mapping[str, str] = fixed.TRACKED_ACTORS) -> DataFrame:
    """Event counts, fatalities and actor presence of every cell-month that has events."""
    flagged = violence_flags(presence_flags(filter_precision(events), actors), actors["events_gov"])
    sums = {
        "is_statebased": "is_statebased", "is_onesided": "is_onesided", "gov_vs_civilians": "gov_vs_civilians",
        "total_fatalities": "best", "deaths_a": "deaths_a", "deaths_b": "deaths_b",
        "deaths_civilians": "deaths_civilians", **{name: name for name in actors},
    }
    return ops.aggregate_cell_period(flagged, sums, {"n_unique_dyads": "dyad_name"}, ["adm_1"])


def dense_panel(aggregates: DataFrame, calendar: str = "observed") -> DataFrame:
    """Every active cell in every month; numbers are 0 and the state is filled both ways where nothing happened.

    calendar='observed' uses the months that occur anywhere, 'full' every month between first and last.
    """
    aggregates = checkpoint(aggregates)  # used for cells, months and values; bounded by the grid
    months = {"observed": ops.observed_periods, "full": ops.calendar_periods}[calendar](aggregates)
    dense = ops.densify(aggregates, months).fillna(0)
    return ops.fill_both_ways(dense, ["adm_1"]) if "adm_1" in aggregates.columns else dense


def build_panel(
    events: DataFrame, actors: Mapping[str, str] = fixed.TRACKED_ACTORS, calendar: str = "observed",
) -> DataFrame:
    """Dense panel with lags, rolling means and event shares. All windows share one exchange and sort."""
    panel = dense_panel(cell_months(events, actors), calendar)
    panel = ops.add_lags(panel, fixed.LAG_COLUMNS, fixed.BASE_LAGS)
    panel = ops.add_rolling_mean(panel, fixed.ROLL_COLUMNS, [3, 6])
    total = F.col("total_events")
    return panel.withColumns({
        "gov_event_share": safe_ratio(F.col("events_gov"), total),
        "nug_event_share": safe_ratio(F.col("events_nug"), total),
        "year_month_dt": dates.month_start(F.col(PERIOD)),
    })


def static_covariates(raw: DataFrame, cells: DataFrame, wanted: Sequence[str] = fixed.STATIC_COVARIATES) -> DataFrame:
    """Wanted static columns of the given cells, 0 where missing."""
    named = scan_columns(normalize_key(raw), [CELL, *wanted])
    return named.join(cells.select(CELL).distinct(), CELL, "left_semi").fillna(0.0)


def yearly_covariates(raw: DataFrame, cells: DataFrame, wanted: Sequence[str] = fixed.YEARLY_COVARIATES) -> DataFrame:
    """Latest known value of each yearly column per cell; only the cells when no wanted column exists."""
    present = scan_columns(normalize_key(raw), [CELL, "year", *wanted])
    columns = [c for c in present.columns if c in wanted]
    chosen = cells.select(CELL).distinct()
    if not columns:
        return chosen
    numbered = present.withColumn("year", F.col("year").try_cast("int")).join(chosen, CELL, "left_semi")
    return ops.latest_non_null(numbered, CELL, "year", columns).fillna(0.0, subset=columns)


def build_feature_store(
    panel: DataFrame, static: DataFrame | None = None, yearly: DataFrame | None = None,
) -> DataFrame:
    """Panel plus covariates, long lags, rolling means and deviations, trends and more shares."""
    store = left_enrich(panel, static, [CELL])
    store = left_enrich(store, None if yearly is None else yearly.drop("year"), [CELL])
    store = ops.add_lags(store, fixed.LAG_COLUMNS, fixed.EXTENDED_LAGS)
    store = ops.add_rolling_mean(store, fixed.ROLL_COLUMNS, [12])
    store = ops.add_rolling_mean(store, fixed.ACTOR_ROLL_COLUMNS, [3, 6, 12])
    store = ops.add_rolling_std(store, fixed.SPREAD_COLUMNS, [3, 6])
    store = ops.add_trend(store, fixed.SPREAD_COLUMNS)
    return store.withColumns({
        f"{a}_event_share": safe_ratio(F.col(f"events_{a}"), F.col("total_events")) for a in ("kio", "ula", "knu")
    })

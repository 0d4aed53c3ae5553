"""Cell-by-month panels: aggregation, densifying, and windows inside one cell.

A panel is bounded by the grid (259,200 cells) times the calendar, whatever the number of
events. Windows run per cell, so a window task never holds more rows than there are months.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.functions import dates
from celltide.schemas import CELL, KEY, PERIOD


def by_time():
    """Months of one cell in order."""
    return Window.partitionBy(CELL).orderBy(PERIOD)


def aggregate_cell_period(
    events: DataFrame, sums: Mapping[str, str], distinct: Mapping[str, str] = {},
    firsts: Sequence[str] = (), date: str = "date_start", count: str = "total_events",
) -> DataFrame:
    """Counts, sums, distinct counts and earliest non-null values per cell and month of ``date``.

    Aggregated twice: first by key plus every text column, where all buffers have a fixed width
    (hash aggregation, combined before the shuffle), then by key alone on the reduced rows. A cell
    holding a third of all events therefore crosses the network as its few distinct combinations.
    Months stay dates until the end, which is cheaper to compute and to shuffle than their text.
    """
    texts = [*dict.fromkeys([*distinct.values(), *firsts])]
    dated = events.filter(F.col(CELL).isNotNull() & F.col(date).isNotNull())
    fine = dated.withColumn("_month", F.trunc(date, "month")).groupBy(CELL, "_month", *texts).agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
        *([F.min(date).alias("_first")] if firsts else []),
    )
    def earliest(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_first", c)))
    monthly = fine.groupBy(CELL, "_month").agg(
        F.sum("_n").alias(count),
        *[F.coalesce(F.sum(f"_sum_{name}"), F.lit(0)).alias(name) for name in sums],
        *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
        *[earliest(c).alias(c) for c in firsts],
    )
    return monthly.select(CELL, dates.month_of(F.col("_month")).alias(PERIOD), *[c for c in monthly.columns if c not in (CELL, "_month")])


def observed_periods(df: DataFrame, since: str | None = None) -> Column:
    """Sorted array of the months that occur, as a scalar subquery (bounded by the calendar)."""
    rows = df.select(PERIOD) if since is None else df.select(PERIOD).filter(F.col(PERIOD) >= since)
    return rows.agg(F.array_sort(F.collect_set(PERIOD)).alias("p")).scalar()


def calendar_periods(df: DataFrame, since: str | None = None) -> Column:
    """Every month from the first to the last that occurs, without gaps."""
    rows = df.select(PERIOD) if since is None else df.select(PERIOD).filter(F.col(PERIOD) >= since)
    span = F.sequence(
        dates.month_start(F.min(PERIOD)), dates.month_start(F.max(PERIOD)), F.expr("INTERVAL 1 MONTH")
    )
    return rows.agg(F.transform(span, dates.month_of).alias("p")).scalar()


def panel_skeleton(cells: DataFrame, periods: Column) -> DataFrame:
    """Every cell with every month. The months arrive as one array, so nothing is cross joined."""
    return cells.select(CELL).distinct().withColumn("_p", periods).select(CELL, F.explode("_p").alias(PERIOD))


def densify(aggregates: DataFrame, periods: Column) -> DataFrame:
    """Aggregates on the full skeleton of their cells; months without rows stay NULL."""
    return panel_skeleton(aggregates, periods).join(aggregates, KEY, "left")


def add_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], fill=0) -> DataFrame:
    return df.withColumns({
        f"{c}_lag{k}": F.coalesce(F.lag(c, k).over(by_time()), F.lit(fill))
        for k in lags for c in columns if f"{c}_lag{k}" not in df.columns
    })


def _trailing(width: int):
    return by_time().rowsBetween(-(width - 1), 0)


def add_rolling_mean(df: DataFrame, columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    return df.withColumns({
        f"{c}_roll{w}m": F.avg(c).over(_trailing(w))
        for w in widths for c in columns if f"{c}_roll{w}m" not in df.columns
    })


def add_rolling_std(df: DataFrame, columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Sample deviation over the last rows; one row alone gives 0."""
    return df.withColumns({
        f"{c}_std{w}m": F.coalesce(F.stddev_samp(c).over(_trailing(w)), F.lit(0.0))
        for w in widths for c in columns
    })


def add_trend(df: DataFrame, columns: Sequence[str], short: int = 3, long: int = 6) -> DataFrame:
    return df.withColumns({
        f"{c}_trend": F.avg(c).over(_trailing(short)) - F.avg(c).over(_trailing(long)) for c in columns
    })


def carry_forward(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last observation carried forward inside each cell."""
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def fill_both_ways(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, inside each cell."""
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    future = by_time().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(future))
        for c in columns
    })


def changed_nearby(column: str, boundary: str = "changed") -> Column:
    """True when the value differs from the previous or the next month of the cell.

    ``boundary`` says what a missing neighbour counts as: 'changed' or 'stable'.
    """
    before, after = F.lag(column).over(by_time()), F.lead(column).over(by_time())
    here = F.col(column)
    if boundary == "changed":
        return ~before.eqNullSafe(here) | ~after.eqNullSafe(here)
    if boundary == "stable":
        place = F.row_number().over(by_time())
        size = F.count("*").over(Window.partitionBy(CELL))
        return ((place > 1) & ~before.eqNullSafe(here)) | ((place < size) & ~after.eqNullSafe(here))
    raise ValueError(f"boundary must be 'changed' or 'stable', got {boundary!r}")


def latest_non_null(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Per key, each column's last non-null value by ``order``, column by column.

    Columns may come from different rows. Ties on ``order`` go to the larger value.
    """
    ranked = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    return ranked.groupBy(key).agg(
        F.max(order).alias(order),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns],
    )

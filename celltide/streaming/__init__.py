"""Structured Streaming form of the cell-month aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from celltide.functions import dates, grid
from celltide.schemas import CELL, KEY, PERIOD


def stream_cell_months(
    events: DataFrame, time: str = "ts", lat: str = "latitude", lon: str = "longitude", value: str = "value",
) -> DataFrame:
    """Running counts and sums per cell and calendar month of an unbounded event table.

    Run in update or complete mode. The state holds one row per cell-month, which grid and calendar
    bound; lags and other windows belong to the batch plans that read the sink.
    """
    located = events.select(
        grid.cell_id(F.col(lat), F.col(lon)).alias(CELL), dates.month_of(F.col(time)).alias(PERIOD), F.col(value).alias("_v"))
    return located.dropna(subset=KEY).groupBy(*KEY).agg(
        F.count("*").alias("total_events"), F.sum("_v").alias("total_value"))

"""Merged and labelled event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from celltide import fixed_values as fixed, schemas
from celltide.functions import dates
from celltide.operators.dedup import dedup_by_priority
from celltide.operators.keys import join_dimension
from celltide.schemas import PERIOD
from celltide.sources.readers import Source, union_sources


def merge_sources(
    spark: SparkSession, sources: Sequence[Source], keep: Column | None = None,
    schema=schemas.EVENTS, key: str = "id",
) -> DataFrame:
    """All sources, filtered, aligned and reduced to the best version of each event.

    The source label that sorts last wins, then the earliest start.
    """
    merged = union_sources(spark, sources, schema, keep)
    return dedup_by_priority(merged, key, [F.desc("data_source"), F.col("date_start").asc_nulls_last()])


def with_period(events: DataFrame, columns: Sequence[str] = ("date_start", "date_end")) -> DataFrame:
    """Parse dates and add the month; an unreadable date gives NULL for both."""
    kinds = dict(events.dtypes)
    parsed = events.withColumns({
        c: F.to_date(c) if kinds[c].startswith(("date", "timestamp")) else dates.safe_date(F.col(c))
        for c in columns if c in kinds
    })
    return parsed.withColumn(PERIOD, dates.month_of(F.col(columns[0])))


def label_events(
    events: DataFrame, taxonomy: DataFrame, since: str = fixed.EVENTS_SINCE,
    levels: Mapping[str, str] = fixed.TAXONOMY_LEVELS,
) -> DataFrame:
    """Dated events since a day, with the taxonomy levels of both sides."""
    recent = with_period(events).filter(F.col("date_start") >= F.lit(since).cast("date"))
    return join_dimension(recent, taxonomy, "ucdp_name", levels, ["side_a", "side_b"])

"""One row per key.

Every operator here keeps the best row by ``row_number() = 1``. Spark limits each group before
the shuffle for this shape (WindowGroupLimit), so a key that holds a third of all rows leaves
every map task as a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def dedup_by_priority(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Best row per key. Remaining columns break ties, so that the result never depends on row order."""
    rest = [F.col(c).asc_nulls_last() for c in sorted(df.columns) if c != key]
    return _first_row(df, [key], [*order, *rest])


def last_per_period(df: DataFrame, time: str, period: Column, tie: str) -> DataFrame:
    """Newest row of each period; the larger ``tie`` wins among equal times."""
    dated = df.withColumn("_period", period).filter("_period IS NOT NULL")
    return _first_row(dated, ["_period"], [F.col(time).desc(), F.col(tie).desc()]).drop("_period")


def most_common(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Most frequent category per group and its count; the smaller category wins a tie."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("cnt"))
    return _first_row(counts, keys, [F.desc("cnt"), F.asc(category)])


def distinct_locations(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.select(lat, lon).distinct()


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Rows before and after deduplication by ``key``."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("before"), F.count("*").alias("after"),
        (F.sum("n") - F.count("*")).alias("removed"),
    )

"""Exact running totals and row numbers over one global order, without a single-task sort.

Rows are range-partitioned by the order and each keeps the number of its partition; the placed
rows are stored, because a re-sampled range after a lost executor could move rows between
partitions. Totals per partition are few (partitions x groups), so their prefix sums are cheap,
and each row adds its partition's offset to a total computed inside its partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.runtime import checkpoint

PART = "_part"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, groups: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Rows with the number of the range partition they fall in; numbers rise along the order.

    Without ``parts`` AQE merges neighbouring ranges of little data, which keeps the numbers in order.
    """
    by = [*[F.col(g) for g in groups], *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return checkpoint(ranged.withColumn(PART, F.spark_partition_id()))


def totals_of_placed(
    placed: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, str],
) -> DataFrame:
    """Running totals, including the row itself, of rows that carry a partition number."""
    per_part = placed.groupBy(*groups, PART).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*groups, PART, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums
    ])
    inside = Window.partitionBy(*groups, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    return local.join(offsets, [*groups, PART]).select(
        *[c for c in placed.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def running_totals(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, str], parts: int | None = None,
) -> DataFrame:
    """``sums`` maps output names to the columns summed along the total order ``order``."""
    return totals_of_placed(place(df, groups, order, parts), groups, order, sums).drop(PART)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_index", parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 along a total order."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), [], order, {"_number": "_one"}, parts)
    return counted.withColumn(name, F.col("_number") - 1).drop("_one", "_number")

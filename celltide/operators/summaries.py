"""Frequency tables, bins, top lists, pivots and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from celltide.functions.values import at_least
from celltide.operators.running import running_totals
from celltide.runtime import checkpoint
from celltide.schemas import CELL, PERIOD


def frequency(df: DataFrame, *columns: str, digits: int = 1) -> DataFrame:
    """Count and percentage of each value.

    The total is a scalar subquery over the same counts, whose shuffle Spark reuses.
    """
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, digits))


def intensity_bins(df: DataFrame, column: str, edges: Sequence[int] = (0, 5, 20)) -> DataFrame:
    """Rows per bin: up to the first edge, between consecutive edges, and beyond the last."""
    c = F.col(column)
    names = [f"<={edges[0]}"] + [f"{a + 1}-{b}" for a, b in zip(edges, edges[1:])]
    chain = F.when(c <= edges[0], names[0])
    for name, edge in zip(names[1:], edges[1:]):
        chain = chain.when(c <= edge, name)
    binned = df.filter(c.isNotNull()).select(chain.otherwise(f">{edges[-1]}").alias("bin"))
    return frequency(binned, "bin")


def precision_report(df: DataFrame, column: str, maximum: int) -> DataFrame:
    """Rows before and after a precision filter; an unknown precision counts as removed."""
    kept = F.count_if(F.col(column) <= maximum)
    return df.agg(
        F.count("*").alias("before"), kept.alias("after"),
        F.round(F.lit(100.0) * (F.count("*") - kept) / at_least(F.count("*"), 1), 1).alias("removed_pct"),
    )


def overview(df: DataFrame, distinct: Mapping[str, str], sums: Mapping[str, str], time: str) -> DataFrame:
    """One row: rows, distinct counts, sums and the covered time span.

    Rows are first combined per distinct key, so the distinct counts see few rows and no row of the
    input is multiplied. Meant for keys with few combinations, such as cell and month.
    """
    per_key = df.groupBy(*distinct.values()).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        F.min(time).alias("_first"), F.max(time).alias("_last"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"),
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()],
        *[F.sum(f"_s_{n}").alias(n) for n in sums],
        F.min("_first").alias("first"), F.max("_last").alias("last"),
    )


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, q0, q1, ...): exact quantiles of each column, interpolated between neighbours; NULLs don't count.

    The distinct values of all columns are counted, placed in one distributed order, and the values around each wanted rank are
    picked by their running totals, so no task holds a column's values.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    reached = running_totals(counts, ["column"], [F.col("value")], {"upto": "n"})
    size = reached.groupBy("column").agg(F.max("upto").alias("size"))
    at = lambda q: F.lit(float(q)) * (F.col("size") - 1)
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    around = reached.join(size, "column").groupBy("column", "size").agg(*[
        f(at(q)) for q in shares for f in (lambda r: value(F.floor(r)), lambda r: value(F.ceil(r)))]).toDF(
        "column", "size", *[f"{side}{i}" for i in range(len(shares)) for side in ("low", "high")])
    return around.select("column", *[
        (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at(q) - F.floor(at(q)))).alias(f"q{i}") for i, q in enumerate(shares)])


def describe_columns(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each column, one row each; quartiles are exact."""
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev_samp(c), digits).alias("std"),
            F.round(F.min(c).cast("double"), digits).alias("min"), F.round(F.max(c).cast("double"), digits).alias("max"),
        ) for c in columns
    ]
    stored = checkpoint(df.select(*columns))
    quartiles = quantiles(stored, columns, (0.25, 0.5, 0.75)).select(
        "column", *[F.round(f"q{i}", digits).alias(f"p{p}") for i, p in enumerate((25, 50, 75))])
    return stored.agg(F.array(*parts).alias("rows")).select(F.inline("rows")).join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def top_groups(df: DataFrame, key: str, value: str, label: str, k: int = 10) -> DataFrame:
    """Groups with the largest totals, each with its earliest label."""
    totals = df.groupBy(key).agg(
        F.sum(value).alias("total"),
        F.min_by(label, F.when(F.col(label).isNotNull(), F.struct(PERIOD, label))).alias(label),
    )
    return totals.orderBy(F.desc("total"), key).limit(k)


def composition(df: DataFrame, key: str, column: str, values: Sequence[str], clip: bool = True) -> DataFrame:
    """Count of each value per group, the group size, and the share of the last value."""
    counts = df.groupBy(key).agg(
        *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"),
    )
    size = at_least(F.col("total"), 1) if clip else F.col("total")
    return counts.withColumn(f"{values[-1]}_rate", F.col(f"n_{values[-1]}") / size)


def cell_composition(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Composition per cell with its months and most frequent value (the smaller value wins a tie)."""
    counts = composition(df, CELL, column, values)
    best = F.greatest(*[F.col(f"n_{v}") for v in values])
    dominant = F.when(F.lit(False), F.lit(None).cast("string"))
    for v in sorted(values):
        dominant = dominant.when(F.col(f"n_{v}") == best, v)
    return counts.withColumn("dominant", dominant).withColumnRenamed("total", "n_months")


def breakdown(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by both columns, with a total per outer value and a grand total (NULL keys)."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"))


def true_share(df: DataFrame, condition: Column, name: str = "share") -> DataFrame:
    return df.agg(F.avg(condition.cast("double")).alias(name))


def period_flag_counts(df: DataFrame, flag: str) -> DataFrame:
    """Months in which the flag holds somewhere, and months in which it does not."""
    per_month = df.groupBy(PERIOD).agg(F.bool_or(flag).alias("f"))
    return per_month.agg(F.count_if("f").alias("n_true"), F.count_if(~F.col("f")).alias("n_false"))


def pivot_models(df: DataFrame, row: str, model: str, value: str, models: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(model, list(models)).agg(F.max(value))


def evenly_spaced_periods(df: DataFrame, k: int) -> DataFrame:
    """``k`` periods spread over the sorted distinct periods, first and last included."""
    place = F.row_number().over(Window.orderBy(PERIOD))  # bounded by the calendar
    months = df.select(PERIOD).distinct().select(PERIOD, (place - 1).alias("place"))
    size = F.count("*").over(Window.partitionBy())
    picks = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")) - 1),
        lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(F.least(F.lit(k), F.col("n")) - 1, F.lit(1))),
    )
    return (
        months.withColumn("n", size)
        .filter(F.array_contains(picks, F.col("place").cast("long"))).select(PERIOD)
    )


def middle_period(df: DataFrame) -> DataFrame:
    months = df.select(PERIOD).distinct()
    return months.agg(F.array_sort(F.collect_list(PERIOD)).alias("p")).select(
        F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")).alias(PERIOD))


def numeric_features(df: DataFrame, metadata: Sequence[str]) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in metadata
    ]

"""Joins on keys and dimensions, and comparisons of key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from celltide.schemas import KEY


def join_dimension(
    df: DataFrame, dim: DataFrame, dim_key: str, outputs: Mapping[str, str], on: Sequence[str],
) -> DataFrame:
    """Left join of one dimension once per column of ``on``; outputs are prefixed with that column.

    Whether the dimension is broadcast is left to Spark, which knows its bytes.
    """
    dim = dim.select(dim_key, *outputs)
    for column in on:
        side = dim.select(
            F.col(dim_key).alias(column),
            *[F.col(c).alias(f"{column}_{suffix}") for c, suffix in outputs.items()],
        )
        df = df.join(side, column, "left")
    return df


def unmatched_keys(df: DataFrame, dim: DataFrame, dim_key: str, on: Sequence[str]) -> DataFrame:
    """Distinct values of each column of ``on`` that the dimension lacks, as (side, name).

    Values are made distinct before the anti join, so the join sees names, not events.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("side"), F.col(c).alias("name")) for c in on
    ])).alias("pair")
    names = df.select(pairs).select("pair.side", "pair.name").filter("name IS NOT NULL").distinct()
    known = dim.select(F.col(dim_key).alias("name")).distinct()
    return names.join(known, "name", "left_anti").select("side", "name")


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def exclude_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def left_enrich(df: DataFrame, extra: DataFrame | None, on: Sequence[str], fill=0.0) -> DataFrame:
    """Left join optional columns and fill what has no match; without ``extra`` nothing is joined."""
    if extra is None:
        return df
    added = [c for c in extra.columns if c not in on]
    return df.join(extra, list(on), "left").fillna(fill, subset=added)


def key_differences(reference: DataFrame, others: Mapping[str, DataFrame], on: Sequence[str] = KEY) -> DataFrame:
    """Rows only in the reference and only in each other table, as (other, only_in_reference, only_in_other).

    Both sides are tagged and grouped by key, so partial aggregation meets duplicates before the shuffle.
    """
    names = list(others)
    tagged = reference.select(*on, F.explode(F.array(*[F.lit(n) for n in names])).alias("other"), F.lit(1).alias("ref"), F.lit(0).alias("oth"))
    for name in names:
        tagged = tagged.unionByName(
            others[name].select(*on, F.lit(name).alias("other"), F.lit(0).alias("ref"), F.lit(1).alias("oth"))
        )
    per_key = tagged.groupBy("other", *on).agg(F.max("ref").alias("ref"), F.max("oth").alias("oth"))
    return per_key.groupBy("other").agg(
        F.count_if((F.col("ref") == 1) & (F.col("oth") == 0)).alias("only_in_reference"),
        F.count_if((F.col("ref") == 0) & (F.col("oth") == 1)).alias("only_in_other"),
    )


def require_aligned(reference: DataFrame, others: Mapping[str, DataFrame], on: Sequence[str] = KEY) -> None:
    """Raise when any table covers another key set than the reference."""
    bad = key_differences(reference, others, on).filter("only_in_reference > 0 OR only_in_other > 0")
    first = bad.first()
    if first is not None:
        raise ValueError(f"key mismatch: {first.asDict()}")


def flag_members(df: DataFrame, value: Column, members: Sequence, name: str) -> DataFrame:
    """Membership as a flag, keeping all rows."""
    return df.withColumn(name, F.coalesce(value.isin(list(members)), F.lit(False)))

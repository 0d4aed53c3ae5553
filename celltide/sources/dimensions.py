"""Small literal tables as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from celltide import fixed_values as fixed


def dimension(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def mark_table(spark: SparkSession) -> DataFrame:
    rows = [(mark, *meaning) for mark, meaning in fixed.MARKS.items()]
    return dimension(spark, rows, "mark string, control_status string, actor string, confidence string")


def fallback_table(spark: SparkSession) -> DataFrame:
    rows = [(kind, *outcome) for kind, outcome in fixed.TYPE_FALLBACK.items()]
    return dimension(spark, rows, "inter1 string, side string, coalition string, actor_group string")

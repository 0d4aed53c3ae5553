"""Dates and calendar months. Bad input gives NULL, never an error, also under ANSI mode."""

from pyspark.sql import Column, functions as F


def safe_date(value: Column) -> Column:
    return F.to_date(F.try_to_timestamp(value.cast("string")))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("-01")))


def month_number(period: Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    return (
        F.substring(period, 1, 4).cast("long") * 12 + F.substring(period, 6, 2).cast("long") - 1
    )


def iso_timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value)

"""Sinks."""

from pyspark.sql import DataFrame, functions as F

from celltide.schemas import PERIOD


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_panel(df: DataFrame, path: str, by_period: bool = False) -> None:
    """Parquet; with ``by_period`` each month is its own folder, holding few and large files.

    The rebalance hint gathers a month's rows and lets AQE split a month that is much too large.
    """
    if by_period:
        df.hint("rebalance", F.col(PERIOD)).write.mode("overwrite").partitionBy(PERIOD).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_revision_log(revisions: DataFrame, path: str) -> None:
    """JSON records of the selected revisions, without their content."""
    (
        revisions.select("revid", "timestamp", F.coalesce("comment", F.lit("")).alias("comment"))
        .write.mode("overwrite").json(path)
    )


def append_variant(df: DataFrame, path: str, variant: str) -> None:
    """Add one variant's results at once, so that a later failure loses none of the earlier ones."""
    df.withColumn("variant", F.lit(variant)).write.mode("append").parquet(path)

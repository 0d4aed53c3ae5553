"""Persistence and proportional-draw baselines, class weights and standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.functions.values import hash_uniform, map_values
from celltide.operators.keys import restrict_to_keys
from celltide.operators.panel import by_time
from celltide.schemas import CELL, CLASSES, CLASS_CODES, KEY, PERIOD, PREDICTION_COLUMNS


def is_train(cutoff: str) -> Column:
    return F.col(PERIOD) <= F.lit(cutoff)


def to_contract(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The eleven prediction columns in their fixed order."""
    coded = df.withColumn("pred_class_int", map_values(F.col("pred_class"), CLASS_CODES)).withColumn("has_label", F.lit(True))
    return coded.select(*extra, *PREDICTION_COLUMNS)


def majority_class(target: DataFrame, fit: Column, label: str = "target") -> Column:
    """Most frequent label of the fitted rows as a scalar subquery; the smaller label wins a tie."""
    counts = target.filter(fit).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), label)).alias("m")).scalar()


def predict_no_change(target: DataFrame, valid: DataFrame, cutoff: str) -> DataFrame:
    """Last known earlier label of the cell, else the training majority; limited to valid cells."""
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    carried = target.select(
        *KEY, F.col("target").alias("true_class"), F.last("target", ignorenulls=True).over(past).alias("_before"))
    kept = restrict_to_keys(carried, valid, [CELL])
    named = kept.withColumn("pred_class", F.coalesce("_before", majority_class(target, is_train(cutoff))))
    return to_contract(named.withColumns({
        **{f"prob_{c}": (F.col("pred_class") == c).cast("double") for c in CLASSES},
        "confidence": F.lit(1.0), "is_train_month": is_train(cutoff),
    }))


def class_shares(target: DataFrame, fit: Column, label: str = "target", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Share of each class among the fitted rows; a class that does not occur has share 0."""
    counts = target.filter(fit).agg(
        *[F.count_if(F.col(label) == c).alias(c) for c in classes])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(c) / total).alias("share")) for c in classes])))


def predict_random(target: DataFrame, valid: DataFrame, cutoff: str, seed: int = 42) -> DataFrame:
    """Draw each label from the training shares with a number that depends on seed, cell and month only."""
    rows = restrict_to_keys(target.select(*KEY, F.col("target").alias("true_class")), valid, [CELL])
    fitted = rows.withColumnRenamed("true_class", "target")
    shares = class_shares(fitted, is_train(cutoff)).agg(
        F.map_from_entries(F.collect_list(F.struct("class", "share"))).alias("s")).scalar()
    drawn = rows.withColumn("_s", shares).withColumn("_u", hash_uniform(F.lit(seed), F.col(CELL), F.col(PERIOD)))
    probability = {c: F.element_at("_s", c) for c in CLASSES}
    chain, reached = None, F.lit(0.0)
    for c in CLASSES[:-1]:
        reached = reached + probability[c]
        chain = F.when(F.col("_u") < reached, c) if chain is None else chain.when(F.col("_u") < reached, c)
    return to_contract(drawn.withColumns({
        "pred_class": chain.otherwise(CLASSES[-1]),
        **{f"prob_{c}": probability[c] for c in CLASSES},
        "confidence": F.greatest(*probability.values()), "is_train_month": is_train(cutoff),
    }))


def class_weights(target: DataFrame, fit: Column | None = None, label: str = "target", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Inverse-frequency weights: rows / (classes x rows of the class). NULL for an absent class."""
    source = target if fit is None else target.filter(fit)
    counts = source.agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    weight = lambda c: F.when(F.col(c) > 0, total / (F.col(c) * F.lit(len(classes))))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(c).alias("n"), weight(c).alias("weight")) for c in classes])))


def standardize(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """Subtract the fitted mean and divide by the fitted sample deviation (1 where it is 0)."""
    moments = df.filter(fit).agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    ).alias("m")).scalar()
    spread = lambda c: F.when(F.col(f"_m.s_{c}") == 0, 1.0).otherwise(F.col(f"_m.s_{c}"))
    return df.withColumn("_m", moments).withColumns({
        c: (F.col(c) - F.col(f"_m.m_{c}")) / spread(c) for c in columns
    }).drop("_m")

"""One-vs-rest ROC and precision-recall: curves, areas and grid interpolation.

Rows are first reduced to distinct scores (partial aggregation takes care of a score that a third
of the rows share); cumulative counts then use the distributed running totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.operators.running import running_totals
from celltide.schemas import CLASSES

SCORES = {c: f"prob_{c}" for c in CLASSES}
GRID_STEPS = 100


def score_counts(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """Positives and negatives at every distinct score of every class."""
    per_class = F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(s).alias("score"), (F.col("true_class") == c).alias("hit"))
        for c, s in scores.items()
    ])).alias("s")
    return df.select(*groups, per_class).select(*groups, "s.*").groupBy(*groups, "class", "score").agg(
        F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))


def cumulative_counts(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts at or above each score (cum_pos, cum_neg) and the totals of the group (all_pos, all_neg)."""
    keys = [*groups, "class"]
    running = running_totals(counts, keys, [F.desc("score")], {"cum_pos": "pos", "cum_neg": "neg"})
    totals = running.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running.join(totals, keys)


def area_terms() -> list[Column]:
    """Aggregates for ROC AUC (ties count half) and average precision over cumulative rows."""
    pos, neg, cum_pos, cum_neg = (F.col(c) for c in ("pos", "neg", "cum_pos", "cum_neg"))
    ranked = F.sum(neg * (cum_pos - pos) + neg * pos / 2.0)
    n_pos, n_neg = F.sum(pos), F.sum(neg)
    return [
        F.when((n_pos > 0) & (n_neg > 0), ranked / (n_pos * n_neg)).alias("auc"),
        F.when(n_pos > 0, F.sum(pos * cum_pos / (cum_pos + cum_neg)) / n_pos).alias("ap"),
        n_pos.alias("n_pos"), n_neg.alias("n_neg"),
    ]


def ranking_areas(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """AUC and average precision per group and class; NULL where a class has no positives (or negatives)."""
    rows = cumulative_counts(score_counts(df, groups, scores), groups)
    return rows.groupBy(*groups, "class").agg(*area_terms())


def macro_areas(areas: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means over the classes whose value is defined."""
    return areas.groupBy(*groups).agg(F.avg("auc").alias("macro_auc"), F.avg("ap").alias("macro_ap"))


def chance_reference(df: DataFrame, groups: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Values a ranking without skill reaches: AUC 0.5, average precision equal to prevalence."""
    shares = df.groupBy(*groups).agg(*[F.avg((F.col("true_class") == c).cast("double")).alias(c) for c in classes])
    return shares.select(*groups, F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(0.5).alias("auc"), F.col(c).alias("ap")) for c in classes])))


def roc_points(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """(fpr, tpr) at every distinct score, and (0, 0) with a NULL score as the start."""
    rows = cumulative_counts(score_counts(df, groups, scores), groups).filter("all_pos > 0 AND all_neg > 0")
    keys = [*groups, "class"]
    points = rows.select(
        *keys, "score", (F.col("cum_neg") / F.col("all_neg")).alias("fpr"), (F.col("cum_pos") / F.col("all_pos")).alias("tpr"))
    start = points.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """(recall, precision) at every distinct score, and (0, 1) with a NULL score as the end."""
    rows = cumulative_counts(score_counts(df, groups, scores), groups).filter("all_pos > 0")
    keys = [*groups, "class"]
    points = rows.select(
        *keys, "score", (F.col("cum_pos") / F.col("all_pos")).alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))
    end = points.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return points.unionByName(end)


def area_under(points: DataFrame, x: str, y: str, groups: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Trapezoid area of a curve given as rows, for curves of grid length.

    Long score curves get their area from ``ranking_areas``, which needs no per-group sort.
    """
    along = Window.partitionBy(*groups).orderBy(*(order or [F.col(x)]), F.col(y))
    step = points.select(
        *groups, (F.col(x) - F.lag(x).over(along)).alias("dx"), (F.col(y) + F.lag(y).over(along)).alias("yy"))
    return step.groupBy(*groups).agg(F.coalesce(F.sum(F.col("dx") * F.col("yy") / 2), F.lit(0.0)).alias("area"))


def _on_grid(rows: DataFrame, keys: Sequence[str], before: Column, upto: Column, total: Column,
             y_before: Column, y_here: Column, name: str) -> DataFrame:
    """Linear values at i/100 for the grid points in [before, upto) / total, and at 1 for the last knot.

    Grid positions are found in whole numbers, so no point is lost or doubled by rounding.
    """
    up = lambda count: F.floor((count * GRID_STEPS + total - 1) / total)
    segment = F.sequence(up(before), up(upto) - 1)
    inner = (
        rows.filter(upto > before).filter(up(upto) > up(before))
        .withColumns({"_i": F.explode(segment)})
        .select(
            *keys, F.col("_i").alias("step"),
            (y_before + (F.col("_i") / GRID_STEPS - before / total) / ((upto - before) / total) * (y_here - y_before)).alias(name))
    )
    return inner


def roc_on_grid(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """tpr of every class at fpr = 0.00, 0.01, ..., 1.00."""
    keys = [*groups, "class"]
    rows = cumulative_counts(score_counts(df, groups, scores), groups).filter("all_pos > 0 AND all_neg > 0")
    pos_before, neg_before = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    inner = _on_grid(
        rows, keys, neg_before, F.col("cum_neg"), F.col("all_neg"),
        pos_before / F.col("all_pos"), F.col("cum_pos") / F.col("all_pos"), "tpr")
    end = rows.select(*keys).distinct().select(*keys, F.lit(GRID_STEPS).cast("long").alias("step"), F.lit(1.0).alias("tpr"))
    return inner.unionByName(end)


def pr_on_grid(df: DataFrame, groups: Sequence[str] = (), scores: Mapping[str, str] = SCORES) -> DataFrame:
    """precision of every class at recall = 0.00, 0.01, ..., 1.00."""
    keys = [*groups, "class"]
    rows = cumulative_counts(score_counts(df, groups, scores), groups).filter("all_pos > 0")
    pos_before, neg_before = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    seen = pos_before + neg_before
    precision_before = F.when(seen > 0, pos_before / seen).otherwise(1.0)
    inner = _on_grid(
        rows, keys, pos_before, F.col("cum_pos"), F.col("all_pos"),
        precision_before, F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), "precision")
    end = rows.groupBy(*keys).agg(F.max("all_pos").alias("p"), F.max("all_neg").alias("n")).select(
        *keys, F.lit(GRID_STEPS).cast("long").alias("step"), (F.col("p") / (F.col("p") + F.col("n"))).alias("precision"))
    return inner.unionByName(end)


def macro_curve(on_grid: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean over classes at every grid point."""
    return on_grid.groupBy(*groups, "step").agg(F.avg(value).alias(value))

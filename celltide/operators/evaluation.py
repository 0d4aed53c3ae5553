"""Classification metrics, transitions and model comparison.

Every metric comes from one grouped pass that counts (true, predicted) pairs as fixed-width
columns; the rest is arithmetic on one row per group. Without any row, shares and means are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.operators.keys import restrict_to_keys
from celltide.schemas import CELL, CLASSES, KEY, PERIOD

TRUE, PRED = "true_class", "pred_class"


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _pair(t: str, p: str) -> str:
    return f"n_{t}_{p}"


def pair_counts(
    df: DataFrame, groups: Sequence[str] = (), classes: Sequence[str] = CLASSES, weight: str | None = None,
) -> DataFrame:
    """One row per group with the count of every (true, predicted) pair, or the sum of ``weight``."""
    def count(condition: Column) -> Column:
        return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))
    pairs = [
        count((F.col(TRUE) == t) & (F.col(PRED) == p)).alias(_pair(t, p))
        for t in classes for p in classes
    ]
    return df.groupBy(*groups).agg(*pairs)


def class_parts(c: str, classes: Sequence[str]) -> dict[str, Column]:
    hit = F.col(_pair(c, c))
    support = _sum([F.col(_pair(c, p)) for p in classes])
    predicted = _sum([F.col(_pair(t, c)) for t in classes])
    zero = F.lit(0.0)
    return {
        "precision": F.when(predicted > 0, hit / predicted).otherwise(zero),
        "recall": F.when(support > 0, hit / support).otherwise(zero),
        "f1": F.when(support + predicted > 0, F.lit(2.0) * hit / (support + predicted)).otherwise(zero),
        "support": support,
        "present": support + predicted > 0,
    }


def _total(classes: Sequence[str]) -> Column:
    return _sum([F.col(_pair(t, p)) for t in classes for p in classes])


def _accuracy(classes: Sequence[str]) -> Column:
    return F.try_divide(_sum([F.col(_pair(c, c)) for c in classes]), _total(classes))


def _macro(part: str, average_over: str, classes: Sequence[str]) -> Column:
    """Mean over 'all' classes, or over those 'present' in truth or prediction."""
    parts = [class_parts(c, classes) for c in classes]
    if average_over == "all":
        return _sum([p[part] for p in parts]) / F.lit(float(len(classes)))
    if average_over == "present":
        kept = _sum([F.when(p["present"], p[part]).otherwise(0.0) for p in parts])
        return F.try_divide(kept, _sum([p["present"].cast("int") for p in parts]))
    raise ValueError(f"average_over must be 'all' or 'present', got {average_over!r}")


def short_name(c: str) -> str:
    return "unc" if c == "uncertain" else c


def f1_summary(
    df: DataFrame, groups: Sequence[str] = (), average_over: str = "present",
    classes: Sequence[str] = CLASSES, digits: int | None = 4,
) -> DataFrame:
    """Rows, accuracy, macro F1 and F1 per class of every group."""
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return pair_counts(df, groups, classes).select(
        *groups, _total(classes).alias("n"), rounded(_accuracy(classes)).alias("accuracy"),
        rounded(_macro("f1", average_over, classes)).alias("macro_f1"),
        *[rounded(class_parts(c, classes)["f1"]).alias(f"{short_name(c)}_f1") for c in classes],
    )


def confusion_matrix(df: DataFrame, groups: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """All pairs with their count and their share of the true class's row."""
    cells = []
    for t in classes:
        row = _sum([F.col(_pair(t, p)) for p in classes])
        cells += [
            F.struct(
                F.lit(t).alias(TRUE), F.lit(p).alias(PRED), F.col(_pair(t, p)).alias("n"),
                (F.col(_pair(t, p)) / (row + F.lit(1e-8))).alias("row_share"),
            ) for p in classes
        ]
    return pair_counts(df, groups, classes).select(*groups, F.inline(F.array(*cells)))


def misclassifications(df: DataFrame, groups: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    return (
        confusion_matrix(df, groups, classes).filter((F.col(TRUE) != F.col(PRED)) & (F.col("n") > 0))
        .select(*groups, TRUE, PRED, "n", F.round(F.col("row_share") * 100, 1).alias("pct"))
    )


def classification_report(df: DataFrame, groups: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    parts = {c: class_parts(c, classes) for c in classes}
    total = _total(classes)
    def row(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[values[m].alias(m) for m in ("precision", "recall", "f1")],
            support.alias("support"),
        )
    rows = [row(c, parts[c], parts[c]["support"]) for c in classes]
    measures = ("precision", "recall", "f1")
    rows.append(row("macro avg", {m: _macro(m, "all", classes) for m in measures}, total))
    rows.append(row("weighted avg", {
        m: F.try_divide(_sum([parts[c][m] * parts[c]["support"] for c in classes]), total) for m in measures
    }, total))
    return pair_counts(df, groups, classes).select(*groups, F.inline(F.array(*rows)))


def accuracy_lift(df: DataFrame, groups: Sequence[str] = (), constant: str = CLASSES[0]) -> DataFrame:
    """Accuracy, accuracy of always predicting ``constant``, and their difference."""
    share = lambda condition: F.avg(condition.cast("double"))
    hit, base = F.col(TRUE) == F.col(PRED), F.col(TRUE) == constant
    return df.groupBy(*groups).agg(
        share(hit).alias("accuracy"), share(base).alias("baseline_accuracy"),
        (share(hit) - share(base)).alias("lift"),
    )


def accuracy_by_class(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, TRUE).agg(
        F.count("*").alias("n"), F.avg((F.col(TRUE) == F.col(PRED)).cast("double")).alias("accuracy"))


# --- transitions --------------------------------------------------------------------------


def with_previous(df: DataFrame, groups: Sequence[str] = (), scope: str = "full") -> DataFrame:
    """Validation rows with the previous true class and ``is_transition``.

    scope='full' looks back over all months and treats a cell's first month as stable;
    scope='validation' looks back inside the validation months only and drops each first month.
    """
    by_time = Window.partitionBy(*groups, CELL).orderBy(PERIOD)
    before = F.lag(TRUE).over(by_time)
    if scope == "full":
        rows = df.withColumn("prev_true", F.coalesce(before, F.col(TRUE))).filter(~F.col("is_train_month"))
    elif scope == "validation":
        rows = df.filter(~F.col("is_train_month")).withColumn("prev_true", before).filter("prev_true IS NOT NULL")
    else:
        raise ValueError(f"scope must be 'full' or 'validation', got {scope!r}")
    return rows.withColumn("is_transition", F.col("prev_true") != F.col(TRUE))


def transition_keys(df: DataFrame) -> DataFrame:
    """Validation cell-months whose true class differs from the month before."""
    return with_previous(df).filter("is_transition").select(*KEY)


def validation_rows(df: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    rows = df.filter(~F.col("is_train_month"))
    return rows if keys is None else restrict_to_keys(rows, keys)


def transition_accuracy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and accuracies of transitions and stable rows inside the validation months."""
    hit, moved = F.col(TRUE) == F.col(PRED), F.col("is_transition")
    n_moved, n_stable = F.count_if(moved), F.count_if(~moved)
    return with_previous(df, groups, scope="validation").groupBy(*groups).agg(
        (F.count_if(moved & hit) / F.greatest(n_moved, F.lit(1))).alias("trans_acc"),
        (F.count_if(~moved & hit) / F.greatest(n_stable, F.lit(1))).alias("stable_acc"),
        n_moved.alias("n_trans"), n_stable.alias("n_stable"),
    )


def direction_table(df: DataFrame, groups: Sequence[str] = (), scope: str = "validation") -> DataFrame:
    """Transitions by direction with hits, hit rate and a three-step grade."""
    hit = (F.col(TRUE) == F.col(PRED)).cast("long")
    moved = with_previous(df, groups, scope).filter("is_transition")
    table = moved.groupBy(*groups, F.col("prev_true").alias("from_class"), F.col(TRUE).alias("to_class")).agg(
        F.count("*").alias("n"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("hit_rate"))
    grade = F.when(F.col("hit_rate") >= 0.5, "good").when(F.col("hit_rate") >= 0.25, "fair").otherwise("poor")
    return table.withColumn("grade", grade)


def transition_types(df: DataFrame) -> DataFrame:
    """Cell, month and type ('a→b') of each validation transition."""
    moved = with_previous(df).filter("is_transition")
    return moved.select(*KEY, F.concat("prev_true", F.lit("→"), TRUE).alias("transition_type"))


def model_comparison(df: DataFrame, groups: Sequence[str] = ("model",), digits: int = 4) -> DataFrame:
    """One row per model: overall metrics and transition accuracies of the validation months.

    The window gives each validation row its previous class; one aggregation does the rest.
    """
    groups = list(groups)
    by_time = Window.partitionBy(*groups, CELL).orderBy(PERIOD)
    rows = validation_rows(df).withColumn("prev_true", F.lag(TRUE).over(by_time))
    hit = F.col(TRUE) == F.col(PRED)
    moved = F.col("prev_true").isNotNull() & (F.col("prev_true") != F.col(TRUE))
    stable = F.col("prev_true").isNotNull() & (F.col("prev_true") == F.col(TRUE))
    pairs = [
        F.count_if((F.col(TRUE) == t) & (F.col(PRED) == p)).alias(_pair(t, p)) for t in CLASSES for p in CLASSES
    ]
    counted = rows.groupBy(*groups).agg(
        *pairs, F.count_if(moved).alias("n_trans"), F.count_if(stable).alias("n_stable"),
        F.count_if(moved & hit).alias("_moved_hit"), F.count_if(stable & hit).alias("_stable_hit"),
    )
    rounded = lambda c: F.round(c, digits)
    return counted.select(
        *groups, _total(CLASSES).alias("n_val"), rounded(_accuracy(CLASSES)).alias("accuracy"),
        rounded(_macro("f1", "all", CLASSES)).alias("macro_f1"),
        *[rounded(class_parts(c, CLASSES)["f1"]).alias(f"{short_name(c)}_f1") for c in CLASSES],
        rounded(F.col("_moved_hit") / F.greatest("n_trans", F.lit(1))).alias("trans_acc"),
        rounded(F.col("_stable_hit") / F.greatest("n_stable", F.lit(1))).alias("stable_acc"),
        "n_trans", "n_stable",
    )


def stable_transition_summary(df: DataFrame, keys: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Overall accuracy, accuracy off the key set, recall on it, and its size, per model."""
    groups = list(groups)
    marks = keys.select(*KEY).distinct().withColumn("_mark", F.lit(True))
    tagged = validation_rows(df).join(marks, KEY, "left").withColumn("_moved", F.col("_mark").isNotNull())
    hit = (F.col(TRUE) == F.col(PRED)).cast("double")
    return tagged.groupBy(*groups).agg(
        F.round(F.avg(hit), 4).alias("overall_acc"),
        F.round(F.avg(F.when(~F.col("_moved"), hit)), 4).alias("stable_acc"),
        F.round(F.avg(F.when(F.col("_moved"), hit)), 4).alias("transition_recall"),
        F.count_if("_moved").alias("n_transition_events"),
    )


def cell_recall(df: DataFrame, keys: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Recall per cell on the key set, with the number of events."""
    hit = (F.col(TRUE) == F.col(PRED)).cast("double")
    return validation_rows(df, keys).groupBy(*groups, CELL).agg(
        F.avg(hit).alias("recall"), F.count("*").alias("n_events"))


def attach_to_cells(cells: DataFrame, per_cell: DataFrame) -> DataFrame:
    """Per-cell values on all cells; NULL says that nothing happened there."""
    return cells.select(CELL).distinct().join(per_cell, CELL, "left")


def monthly_macro_f1(df: DataFrame, keys: DataFrame | None = None, groups: Sequence[str] = ("model",)) -> DataFrame:
    return f1_summary(validation_rows(df, keys), [*groups, PERIOD], digits=None).select(
        *groups, PERIOD, "macro_f1", "n")


def prediction_status(cells: DataFrame, predictions: DataFrame) -> DataFrame:
    """Correct, wrong or no_prediction for every cell."""
    joined = cells.select(CELL).distinct().join(predictions.select(CELL, PRED, TRUE), CELL, "left")
    status = F.when(F.col(PRED).isNull(), "no_prediction").when(F.col(PRED) == F.col(TRUE), "correct")
    return joined.select(CELL, status.otherwise("wrong").alias("status"))


def sample_sizes(df: DataFrame) -> DataFrame:
    """Sizes of the validation sample and of its transitions, as (category, metric, value)."""
    rows = with_previous(df)
    moved = F.col("is_transition")
    sizes = rows.agg(
        F.count_distinct(CELL).alias("cells"), F.count("*").alias("n"),
        F.min(PERIOD).alias("first"), F.max(PERIOD).alias("last"), F.count_distinct(PERIOD).alias("months"),
        F.count_if(moved).alias("events"),
        F.count_distinct(F.when(moved, F.col(CELL))).alias("moved_cells"),
    )
    lines = [
        ("Overall", "Unique cells", F.col("cells").cast("string")),
        ("Overall", "Cell-months", F.col("n").cast("string")),
        ("Overall", "Window", F.concat("first", F.lit(" → "), "last")),
        ("Overall", "Months", F.col("months").cast("string")),
        ("Transition", "Transition events", F.col("events").cast("string")),
        ("Transition", "Cells with transitions", F.col("moved_cells").cast("string")),
    ]
    return sizes.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("category"), F.lit(b).alias("metric"), v.alias("value")) for a, b, v in lines
    ])))


def headline_table(df: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Validation metrics as percentages with one digit, ready to print."""
    summary = f1_summary(validation_rows(df), groups, average_over="all", digits=None)
    pct = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))
    measures = ["accuracy", "macro_f1", *[f"{short_name(c)}_f1" for c in CLASSES]]
    return summary.select(*groups, "n", *[pct(c).alias(c) for c in measures])


def fold_differences(metrics: DataFrame, columns: Sequence[str], groups: Sequence[str] = ("fold",)) -> DataFrame:
    """Metrics by (fold, role) side by side, with holdout minus training."""
    pick = lambda c, role: F.max(F.when(F.col("role") == role, F.col(c)))
    return metrics.groupBy(*groups).agg(
        *[pick(c, "training").alias(f"nh_{c}") for c in columns],
        *[pick(c, "holdout").alias(f"h_{c}") for c in columns],
        *[F.round(pick(c, "holdout") - pick(c, "training"), 4).alias(f"delta_{c}") for c in columns],
    )


def fold_summary(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds, and the folds in which the value is missing."""
    rows = [
        F.struct(
            F.lit(c).alias("metric"), F.avg(F.when(~F.isnan(c), F.col(c))).alias("mean"),
            F.stddev_samp(F.when(~F.isnan(c), F.col(c))).alias("std"),
            F.array_sort(F.collect_list(F.when(F.isnan(c) | F.col(c).isNull(), F.col("fold")))).alias("missing_folds"),
        ) for c in columns
    ]
    return metrics.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def best_and_worst(metrics: DataFrame, name: str, value: str) -> DataFrame:
    return metrics.agg(
        F.max_by(name, F.struct(value, -F.col(name))).alias("best"),
        F.min_by(name, F.struct(value, name)).alias("worst"),
    )

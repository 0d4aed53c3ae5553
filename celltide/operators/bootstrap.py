"""Bootstrap intervals for F1, AUC and average precision of several models on the same rows.

Every draw is a hash of (seed, replicate, position), so replicates need no shared state and a lost executor recomputes
the same sample. Replicates are dealt out in blocks. A block's task holds the evaluated rows once, with their scores
ordered once per model and class, and turns each replicate into one multiplicity per row that all models share; what
leaves it is one line per replicate, model and class. Neither draws nor replicated rows are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from celltide.functions.mixing import draw_values
from celltide.functions.values import map_values
from celltide.operators import running
from celltide.operators.curves import SCORES
from celltide.runtime import checkpoint
from celltide.schemas import CLASSES, KEY

#: Replicates of a block. Rows travel once per block, so more of them trade fewer copies for fewer tasks.
BLOCK = 50
POINT = -1  # number of the pseudo-replicate that holds every row once


class _Ranked:
    """One model's rows: where each stands among the drawn ones, its classes, and its scores from the highest down."""

    def __init__(self, rows: pd.DataFrame, names: Sequence[str], columns: Sequence[str]):
        self.at = rows["row_index"].to_numpy()
        self.pair = rows["true_code"].to_numpy() * (len(names) + 1) + rows["pred_code"].to_numpy()
        self.names, self.orders = names, []
        for k, column in enumerate(columns):
            value = rows[column].to_numpy(dtype=float)
            order = np.argsort(-value, kind="stable")
            last = np.flatnonzero(np.append(value[order][1:] != value[order][:-1], True)) if len(order) else np.zeros(0, dtype=int)
            self.orders.append((order, last, rows["true_code"].to_numpy()[order] == k))

    def metrics(self, times: np.ndarray) -> list[tuple[str, float, int, float | None, float | None]]:
        """(class, f1, n, auc, ap) of each class, every row counted ``times``."""
        weight, c = times[self.at], len(self.names)
        pairs = np.bincount(self.pair, weight, minlength=(c + 1) ** 2).reshape(c + 1, c + 1)
        out = []
        for k, (order, last, hit) in enumerate(self.orders):
            drawn = weight[order]
            cum_pos, cum_all = np.cumsum(np.where(hit, drawn, 0))[last], np.cumsum(drawn)[last]
            pos, every = np.diff(cum_pos, prepend=0), np.diff(cum_all, prepend=0)
            n_pos, n_neg = pos.sum(), every.sum() - pos.sum()
            seen = pos > 0
            ranked = ((every - pos) * (cum_pos - pos) + (every - pos) * pos / 2.0).sum()
            both = pairs[k].sum() + pairs[:, k].sum()
            out.append((
                self.names[k], 2.0 * pairs[k, k] / both if both else 0.0, int(pairs[k, :c].sum()),
                ranked / (n_pos * n_neg) if n_pos and n_neg else None,
                (pos[seen] * cum_pos[seen] / cum_all[seen]).sum() / n_pos if n_pos else None))
        return out


def replicate_metrics(
    rows: DataFrame, n_boot: int = 1000, seed: int = 42, scores: Mapping[str, str] = SCORES,
    order: Sequence[str] = KEY, block: int = BLOCK, by: Sequence[str] = (),
) -> DataFrame:
    """F1, AUC and AP per replicate, model and class, with class 'macro' as the mean of the defined ones.

    ``by`` names the columns that tell the models apart; their replicates are paired, as each draws the same
    ``order`` keys for all. A key that a model lacks counts for the others alone. A task holds the evaluated rows of all
    models, which the grid bounds to 259,200 a month. Without rows the result is empty.
    """
    names, columns = list(scores), list(scores.values())
    code = lambda c: F.coalesce(map_values(F.col(c), {n: k for k, n in enumerate(names)}), F.lit(len(names)))
    slim = checkpoint(rows.select(*by, *order, code("true_class").alias("true_code"), code("pred_class").alias("pred_code"), *columns))
    numbered = checkpoint(running.number_rows(slim.select(*order).distinct(), [F.col(c) for c in order]))
    size = numbered.agg(F.count("*").alias("n")).scalar()
    indexed = slim.join(numbered, list(order)).drop(*order).withColumn("_n", size)
    blocks = F.sequence(F.lit(0), F.lit((n_boot - 1) // block if n_boot else 0))
    schema = StructType().add("replicate", IntegerType())
    for name in by:
        schema = schema.add(name, rows.schema[name].dataType)
    schema = schema.add("class", StringType()).add("f1", DoubleType()).add("n", LongType()).add("auc", DoubleType()).add("ap", DoubleType())
    by = list(by)

    def of_block(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        n, out = int(held["_n"].iloc[0]), []
        groups = [(k, _Ranked(g, names, columns)) for k, g in held.groupby(by, dropna=False)] if by else [((), _Ranked(held, names, columns))]
        first = key[0] * block
        for replicate in [*([POINT] if key[0] == 0 else []), *range(first, min(first + block, n_boot))]:
            times = np.ones(n) if replicate == POINT else np.bincount(draw_values(seed, replicate, n), minlength=n).astype(float)
            for k, ranked in groups:
                out += [(replicate, *k, *line) for line in ranked.metrics(times)]
        return pd.DataFrame(out, columns=schema.names).astype({"auc": float, "ap": float})

    dealt = indexed.withColumn("_block", F.explode(blocks)).repartition((n_boot - 1) // block + 1 if n_boot else 1, "_block")
    per_class = dealt.groupBy("_block").applyInPandas(of_block, schema)
    defined = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    per_class = checkpoint(per_class.select("replicate", *by, "class", "f1", "n", defined("auc"), defined("ap")))
    macro = per_class.groupBy("replicate", *by).agg(
        F.lit("macro").alias("class"), F.avg("f1").alias("f1"), F.sum("n").alias("n"),
        F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))
    return per_class.unionByName(macro.select(*per_class.columns))


def bootstrap_intervals(
    metrics: DataFrame, measures: Sequence[str] = ("f1", "auc", "ap"), by: Sequence[str] = (),
) -> DataFrame:
    """Point value and 2.5 / 97.5 percentiles per model, class and measure; undefined replicates are left out."""
    point = F.col("replicate") == POINT
    parts = []
    for m in measures:
        bounds = F.percentile(F.when(~point, F.col(m)), F.array(F.lit(0.025), F.lit(0.975)))
        parts.append(F.struct(
            F.lit(m).alias("measure"), F.max(F.when(point, F.col(m))).alias("value"),
            bounds[0].alias("lower"), bounds[1].alias("upper")))
    grouped = metrics.groupBy(*by, "class").agg(
        F.max(F.when(point, F.col("n"))).alias("n"), F.array(*parts).alias("parts"))
    return grouped.select(*by, "class", "n", F.inline("parts"))


def format_interval(value: Column, lower: Column, upper: Column, digits: int = 3) -> Column:
    """'v [lo, hi]', or 'n/a' when any part is missing."""
    missing = lambda c: c.isNull() | F.isnan(c)
    text = F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", value, lower, upper)
    return F.when(missing(value) | missing(lower) | missing(upper), "n/a").otherwise(text)

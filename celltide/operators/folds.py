"""Geographic blocks, paired folds and fold roles. Inputs are cells, so at most 259,200 rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.functions import grid
from celltide.functions.mixing import MASK, mix_values
from celltide.runtime import checkpoint
from celltide.schemas import CELL, CLASSES


def _added(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """(restart, centre) sums of one Lloyd step: points, latitudes, longitudes and squared distances, in one aggregation."""
    restarts, k = centres.shape[:2]

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((restarts, k, 4))
        for batch in batches:
            at = batch[["lat", "lon"]].to_numpy()
            for r in range(restarts):
                near, distance = nearest(at, centres[r])
                values = np.column_stack([np.ones(len(at)), at, distance])
                total[r] += np.column_stack([np.bincount(near, values[:, i], minlength=k) for i in range(4)])
        index = np.arange(restarts * k)
        yield pd.DataFrame({"at": index, **{f"s{i}": total.reshape(-1, 4)[:, i] for i in range(4)}})

    parts = points.select("lat", "lon").mapInPandas(of_task, "at long, s0 double, s1 double, s2 double, s3 double")
    out = np.zeros((restarts * k, 4))
    for line in parts.groupBy("at").agg(*[F.sum(f"s{i}") for i in range(4)]).collect():
        out[line[0]] = line[1:]
    return out.reshape(restarts, k, 4)


def nearest(at: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equally near ones, and its squared distance."""
    distance = ((at[:, None, :] - centres[None]) ** 2).sum(axis=2)
    near = distance.argmin(axis=1)
    return near, distance[np.arange(len(at)), near]


def _next_centres(points: DataFrame, centres: np.ndarray, seed: int) -> np.ndarray:
    """One more starting centre per restart, drawn by squared distance from those it has (evenly for the first).

    Every point waits an exponential time, the shorter the farther it lies; the first to come is the draw, so a
    draw is a minimum, which tasks find apart.
    """
    restarts, k = centres.shape[:2]

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.inf, 0, 0.0, 0.0)] * restarts
        for batch in batches:
            at, cell = batch[["lat", "lon"]].to_numpy(), batch[CELL].to_numpy(dtype=np.int64)
            for r in range(restarts) if len(at) else ():
                key = mix_values(mix_values(mix_values(seed & MASK) ^ r) ^ k)
                draw = (mix_values((cell ^ key) & MASK) + 0.5) / (MASK + 1.0)
                weight = nearest(at, centres[r])[1] if k else np.ones(len(at))
                with np.errstate(divide="ignore"):
                    wait = np.where(weight > 0, -np.log(draw) / weight, np.inf)
                i = np.lexsort((cell, wait))[0]
                best[r] = min(best[r], (float(wait[i]), int(cell[i]), *map(float, at[i])))
        yield pd.DataFrame([(r, *b) for r, b in enumerate(best)], columns=["r", "wait", "cell", "lat", "lon"])

    parts = points.select(CELL, "lat", "lon").mapInPandas(of_task, "r long, wait double, cell long, lat double, lon double")
    first = parts.groupBy("r").agg(F.min(F.struct("wait", "cell", "lat", "lon")).alias("b")).orderBy("r").collect()
    return np.concatenate([centres, np.array([[[line["b"]["lat"], line["b"]["lon"]]] for line in first])], axis=1)


def geo_blocks(cells: DataFrame, k: int = 10, seed: int = 42, restarts: int = 20, max_iterations: int = 300) -> DataFrame:
    """k-means on cell centroids; of ``restarts`` seeded runs the one with the lowest cost is kept.

    All restarts go through the cells together: a Lloyd step is one aggregation over (restart, centre), and so is the draw of
    each starting centre. Runs until no centre of any restart moves, so every cell is nearest to the mean of its own
    block; not getting there within ``max_iterations`` is an error. Fewer distinct cells than ``k`` give fewer blocks.
    """
    c = F.col(CELL)
    points = checkpoint(
        cells.select(CELL).distinct().withColumns({"lat": grid.centroid_lat(c), "lon": grid.centroid_lon(c)}))
    k = min(k, points.count())
    if not k:
        return points.withColumn("block", F.lit(0).cast("long"))
    centres = np.zeros((restarts, 0, 2))
    for _ in range(k):
        centres = _next_centres(points, centres, seed)
    for _ in range(max_iterations):
        sums = _added(points, centres)
        held = sums[:, :, :1]
        moved = np.where(held > 0, sums[:, :, 1:3] / np.maximum(held, 1), centres)  # a centre without cells stays
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    else:
        raise RuntimeError(f"blocks still move after {max_iterations} iterations")
    best = centres[int(np.argmin(sums[:, :, 3].sum(axis=1)))]
    distance = lambda i: F.pow(F.col("lat") - float(best[i, 0]), 2) + F.pow(F.col("lon") - float(best[i, 1]), 2)
    near = F.least(*[F.struct(distance(i).alias("d"), F.lit(i).cast("long").alias("block")) for i in range(k)]) if k > 1 else None
    return points.select(CELL, "lat", "lon", near["block"].alias("block") if k > 1 else F.lit(0).cast("long").alias("block"))


def block_faults(blocks: DataFrame) -> DataFrame:
    """How many cells lie nearer to another block's mean than to their own, with the numbers of cells and blocks."""
    means = blocks.groupBy("block").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    listed = means.agg(F.collect_list(F.struct("block", "lat", "lon"))).scalar()  # one entry per block
    square = lambda m: F.pow(F.col("lat") - m["lat"], 2) + F.pow(F.col("lon") - m["lon"], 2)
    own = F.array_min(F.transform(F.filter("_m", lambda m: m["block"] == F.col("block")), square))
    checked = blocks.withColumn("_m", listed).withColumn("_nearer", F.array_min(F.transform("_m", square)) < own - 1e-9)
    return checked.agg(
        F.count("*").alias("n_cells"), F.count_distinct("block").alias("n_blocks"), F.count_if("_nearer").alias("n_nearer_elsewhere"))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(
        F.count_distinct(CELL).alias("n_cells"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def pair_blocks(blocks: DataFrame, n_folds: int = 5) -> DataFrame:
    """Fold of each block: from north to south, every n_folds-th block shares a fold."""
    north_first = Window.orderBy(F.desc("lat"), F.asc("block"))  # one row per block
    return block_stats(blocks).withColumn(
        "fold", ((F.row_number().over(north_first) - 1) % n_folds).cast("long"))


def assign_folds(blocks: DataFrame, n_folds: int = 5) -> DataFrame:
    return blocks.join(pair_blocks(blocks, n_folds).select("block", "fold"), "block", "left").select(CELL, "block", "fold")


def fold_roles(cell_folds: DataFrame, n_folds: int = 5) -> DataFrame:
    """Role of every cell in every fold: holdout in its own, training in the others."""
    every = cell_folds.select(CELL, F.col("fold").alias("_own"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(n_folds - 1).cast("long"))).alias("fold"))
    return every.select(CELL, "fold", F.when(F.col("fold") == F.col("_own"), "holdout").otherwise("training").alias("role"))


def leaking_cells(roles: DataFrame) -> DataFrame:
    """Cells that hold both roles in one fold; empty when the roles are sound."""
    return roles.groupBy("fold", CELL).agg(F.count_distinct("role").alias("n_roles")).filter("n_roles > 1")


def holdout_sizes(roles: DataFrame) -> DataFrame:
    return roles.filter("role = 'holdout'").groupBy("fold").agg(F.count_distinct(CELL).alias("n_cells"))


def class_coverage(labels: DataFrame, cell_folds: DataFrame, label: str = "target", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Classes that each fold's holdout lacks, and whether all are present."""
    per_fold = labels.join(cell_folds.select(CELL, "fold"), CELL).groupBy("fold").agg(
        *[F.bool_or(F.col(label) == c).alias(c) for c in classes])
    missing = F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in classes]), lambda x: x.isNotNull())
    return per_fold.select("fold", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def changed_assignments(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Cells whose fold differs from a saved assignment, or that only one of the two has.

    ``fold`` is the current one, NULL for a cell that only the saved assignment has.
    """
    now, then = current.select(CELL, "fold"), saved.select(CELL, F.col("fold").alias("_saved"))
    both = now.join(then, CELL, "full")
    return both.filter(~F.col("fold").eqNullSafe(F.col("_saved"))).select(CELL, "fold")


def fold_class_weights(labels: DataFrame, roles: DataFrame, fit: Column, label: str = "target", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Inverse-frequency weights per fold from the fitted rows of its training cells."""
    rows = labels.filter(fit).join(roles.filter("role = 'training'"), CELL)
    counts = rows.groupBy("fold").agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes])
    total = sum([F.col(c) for c in classes[1:]], F.col(classes[0]))
    return counts.select("fold", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(c).alias("n"),
                 F.when(F.col(c) > 0, total / (F.col(c) * F.lit(len(classes)))).alias("weight"))
        for c in classes])))

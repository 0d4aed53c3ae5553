"""Cell geometry, raster layout, neighbourhoods and boundary clipping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from celltide.functions import grid
from celltide.functions.values import map_values
from celltide.schemas import CELL, CLASS_CODES, PERIOD


def cell_geometry(cells: DataFrame) -> DataFrame:
    """Row, column, centroid and box of every distinct cell."""
    c = F.col(CELL)
    return cells.select(CELL).filter(c.isNotNull()).distinct().select(
        CELL,
        grid.cell_row(c).alias("grid_row"), grid.cell_col(c).alias("grid_col"),
        grid.centroid_lat(c).alias("lat"), grid.centroid_lon(c).alias("lon"),
        grid.cell_south(c).alias("south"), grid.cell_west(c).alias("west"),
        (grid.cell_south(c) + grid.STEP).alias("north"), (grid.cell_west(c) + grid.STEP).alias("east"),
        grid.cell_wkt(c).alias("wkt"),
    )


def grid_layout(cells: DataFrame, pad: int = 8) -> DataFrame:
    """One row: offset, size and padded size of the raster that holds all cells."""
    c = F.col(CELL)
    extent = cells.agg(
        F.min(grid.cell_row(c)).alias("min_row"), F.min(grid.cell_col(c)).alias("min_col"),
        (F.max(grid.cell_row(c)) - F.min(grid.cell_row(c)) + 1).alias("height"),
        (F.max(grid.cell_col(c)) - F.min(grid.cell_col(c)) + 1).alias("width"),
    )
    padded = lambda size: (F.ceil(F.col(size) / pad) * pad).cast("long")
    return extent.withColumns({"pad_height": padded("height"), "pad_width": padded("width")})


def layout_value(layout: DataFrame) -> Column:
    """The layout row as one struct value, usable in any expression."""
    return layout.select(F.struct(*layout.columns).alias("layout")).scalar()


def to_raster(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Add local_row and local_col; rows outside the padded raster are dropped."""
    c = F.col(CELL)
    placed = (
        df.withColumn("_layout", layout_value(layout))
        .withColumns({
            "local_row": grid.cell_row(c) - F.col("_layout.min_row"),
            "local_col": grid.cell_col(c) - F.col("_layout.min_col"),
        })
        .filter(
            F.col("local_row").between(F.lit(0), F.col("_layout.pad_height") - 1)
            & F.col("local_col").between(F.lit(0), F.col("_layout.pad_width") - 1)
        )
    )
    return placed.drop("_layout")


def valid_cells(feature_cells: DataFrame, target_cells: DataFrame, pad: int = 8) -> DataFrame:
    """Feature cells plus the target cells inside the padded raster of the feature cells."""
    inside = to_raster(target_cells.select(CELL).distinct(), grid_layout(feature_cells, pad))
    return feature_cells.select(CELL).unionByName(inside.select(CELL)).distinct()


def changing_cells(labels: DataFrame, label: str = "target") -> DataFrame:
    """Cells whose label takes more than one value."""
    return (
        labels.groupBy(CELL).agg(F.count_distinct(label).alias("n_classes"))
        .filter("n_classes > 1")
    )


def neighbours(df: DataFrame, radius: int = 1, row: str = "local_row", col: str = "local_col") -> DataFrame:
    """Each row once per cell of its (2r+1)-square neighbourhood, with columns to_row and to_col."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return (
        df.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
        .withColumns({"to_row": F.col(row) + F.col("_dr"), "to_col": F.col(col) + F.col("_dc")})
    )


def focal_cells(
    labels: DataFrame, layout: DataFrame, radius: int = 1, label: str = "target", fit: Column | None = None,
) -> DataFrame:
    """Raster positions within ``radius`` of a changing cell, clipped to the padded raster and the grid.

    ``fit`` limits the rows that decide which cells change, e.g. to training months.
    """
    source = labels if fit is None else labels.filter(fit)
    spread = neighbours(to_raster(changing_cells(source, label), layout), radius)
    box = layout_value(layout)
    return (
        spread.select(F.col("to_row").alias("local_row"), F.col("to_col").alias("local_col")).distinct()
        .withColumn("_layout", box)
        .filter(
            F.col("local_row").between(F.lit(0), F.col("_layout.pad_height") - 1)
            & F.col("local_col").between(F.lit(0), F.col("_layout.pad_width") - 1)
            # a padded raster may reach past the grid, where columns would wrap into other rows
            & (F.col("local_row") + F.col("_layout.min_row")).between(0, grid.ROWS - 1)
            & (F.col("local_col") + F.col("_layout.min_col")).between(0, grid.COLUMNS - 1)
        )
        .withColumn(CELL, grid.cell_at(
            F.col("local_row") + F.col("_layout.min_row"), F.col("local_col") + F.col("_layout.min_col")))
        .select(CELL, "local_row", "local_col")
    )


def neighbour_features(
    panel: DataFrame, columns: Sequence[str], radius: int = 1, include_self: bool = False,
) -> DataFrame:
    """Sum and mean of each column over the existing neighbour cells of the same month.

    Every cell sends its values to its neighbours and the sums combine before the shuffle, so there
    is no self join of neighbours. Cells without a neighbour get 0.
    """
    c = F.col(CELL)
    sent = neighbours(
        panel.select(CELL, PERIOD, *columns)
        .withColumns({"_r": grid.cell_row(c), "_c": grid.cell_col(c)}), radius, "_r", "_c",
    )
    if not include_self:
        sent = sent.filter("_dr <> 0 OR _dc <> 0")
    on_grid = sent.filter(
        F.col("to_row").between(0, grid.ROWS - 1) & F.col("to_col").between(0, grid.COLUMNS - 1)
    )
    received = (
        on_grid.select(grid.cell_at(F.col("to_row"), F.col("to_col")).alias(CELL), PERIOD, *columns)
        .groupBy(CELL, PERIOD).agg(*[
            f(column).alias(f"{column}_{name}") for column in columns
            for name, f in (("nbr_sum", F.sum), ("nbr_mean", F.avg))
        ])
    )
    added = [f"{column}_{name}" for column in columns for name in ("nbr_sum", "nbr_mean")]
    return panel.join(received, [CELL, PERIOD], "left").fillna(0, subset=added)


#: Rows of a band, at least; a wider radius has wider bands, so that a cell lies in the reach of few of them.
BAND_ROWS = 32


def window_features(panel: DataFrame, columns: Sequence[str], radius: int, include_self: bool = False) -> DataFrame:
    """What ``neighbour_features`` gives, for any radius: a cell's cost doesn't grow with its (2r+1)-square window.

    Cells go to bands of rows, with those within ``radius`` of a band sent to it as well, two or three copies in all. A band and
    month is a small raster whose running sums over rows and columns give every window by four look-ups. Sums of whole
    numbers stay exact; NULL values count neither in sums nor in means. Windows end at the edges of the grid.
    """
    rows_of_band, columns = max(BAND_ROWS, 2 * radius + 1), list(columns)
    whole = {c: isinstance(panel.schema[c].dataType, IntegralType) for c in columns}
    names = [f"{c}_{n}" for c in columns for n in ("nbr_sum", "nbr_mean")]
    kinds = ", ".join(f"{c}_nbr_sum {'long' if whole[c] else 'double'}, {c}_nbr_mean double" for c in columns)
    row = grid.cell_row(F.col(CELL))
    band = lambda r: F.floor(r / rows_of_band)
    sent = panel.select(CELL, PERIOD, *columns).withColumn("_row", row).withColumn("_col", grid.cell_col(F.col(CELL))).withColumn(
        "_band", F.explode(F.sequence(band(F.greatest(F.col("_row") - radius, F.lit(0))), band(F.least(F.col("_row") + radius, F.lit(grid.ROWS - 1))))))

    def windows(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        first = key[1] * rows_of_band - radius  # the raster begins a radius above the band
        west = int(held["_col"].min()) - radius
        at = held["_row"].to_numpy() - first, held["_col"].to_numpy() - west
        shape = rows_of_band + 2 * radius + 1, int(held["_col"].max()) - west + radius + 2
        own = (at[0] >= radius) & (at[0] < radius + rows_of_band)
        out = {CELL: held[CELL].to_numpy()[own], PERIOD: held[PERIOD].to_numpy()[own]}
        low, high = (at[0][own] - radius, at[1][own] - radius), (at[0][own] + radius + 1, at[1][own] + radius + 1)

        def summed(values: np.ndarray) -> np.ndarray:
            raster = np.zeros(shape, dtype=values.dtype)
            np.add.at(raster, (at[0] + 1, at[1] + 1), values)
            total = raster.cumsum(axis=0).cumsum(axis=1)
            around = total[high] - total[low[0], high[1]] - total[high[0], low[1]] + total[low]
            return around if include_self else around - values[own]

        for c in columns:
            known = held[c].notna().to_numpy()
            values = np.where(known, held[c].to_numpy(dtype=float), 0.0) if not whole[c] else held[c].fillna(0).to_numpy(dtype=np.int64)
            sums, counts = summed(values), summed(known.astype(np.int64))
            out[f"{c}_nbr_sum"] = np.where(counts > 0, sums, 0)
            out[f"{c}_nbr_mean"] = sums / np.maximum(counts, 1) * (counts > 0)
        return pd.DataFrame(out)

    key_type = panel.schema[PERIOD].dataType.simpleString()
    received = sent.groupBy(PERIOD, "_band").applyInPandas(windows, f"{CELL} long, {PERIOD} {key_type}, {kinds}")
    return panel.join(received, [CELL, PERIOD], "left").fillna(0, subset=names)


def dense_grid(
    panel: DataFrame, layout: DataFrame, features: Sequence[str] = (), label: str = "target", codes=CLASS_CODES, band_rows: int | None = None,
) -> DataFrame:
    """One row per month with row-major arrays: labels (-1 where none), mask, and one array per feature.

    A month has at most 259,200 positions, which bounds every array. With ``band_rows`` there is one row per month and band of
    so many rows of the raster, with its number in ``band`` from 0, and no array or group holds more than a band.
    """
    placed = to_raster(panel, layout)
    box = layout_value(layout)
    placed = placed.withColumn("_layout", box).select(
        PERIOD,
        (F.col("local_row") * F.col("_layout.pad_width") + F.col("local_col")).alias("pos"),
        map_values(F.col(label), codes).cast("int").alias("label"),
        *[F.col(f).cast("float").alias(f) for f in features],
    )
    of_band = F.lit(0) if band_rows is None else F.floor(F.col("pos") / (F.col("_layout.pad_width") * band_rows))
    every = (
        panel.select(PERIOD).distinct().withColumn("_layout", box)
        .select(PERIOD, "_layout", F.explode(F.sequence(
            F.lit(0).cast("long"), F.col("_layout.pad_height") * F.col("_layout.pad_width") - 1)).alias("pos"))
        .select(PERIOD, "pos", of_band.cast("long").alias("band"))
    )
    filled = every.join(placed, [PERIOD, "pos"], "left")
    rows = F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce("label", F.lit(-1)).alias("label"),
        F.col("label").isNotNull().cast("int").alias("mask"),
        *[F.coalesce(f, F.lit(0.0).cast("float")).alias(f) for f in features],
    )))
    keys = [PERIOD] if band_rows is None else [PERIOD, "band"]
    months = filled.groupBy(*keys).agg(rows.alias("cells"))
    return months.select(
        *keys, F.col("cells.label").alias("labels"), F.col("cells.mask").alias("mask"),
        *[F.col(f"cells.{f}").alias(f) for f in features],
    )


def clip_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells whose box meets any polygon: the centroid is inside, or an edge passes through the box.

    ``edges`` has polygon_id, lon1, lat1, lon2, lat2. Inside is decided by the even-odd rule within a
    polygon. Whole cells are kept; their geometry is not cut.

    Each edge is turned into the grid rows it crosses. Crossings of a row's centre line are counted
    per column first and then summed from the east, so the work is linear in edges and cells, and
    a row with very many edges shrinks to at most 720 counts before its window.
    """
    lo_lat, hi_lat = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    row_of = lambda lat: F.floor((lat + 90.0) / grid.STEP)
    spans = edges.withColumn("row", F.explode(F.sequence(row_of(lo_lat), row_of(hi_lat))))
    lon_at = lambda lat: F.col("lon1") + (F.col("lon2") - F.col("lon1")) * (
        (lat - F.col("lat1")) / (F.col("lat2") - F.col("lat1")))

    # Even-odd rule: an edge crosses the centre line of a row half-open in latitude.
    centre = F.col("row") * grid.STEP - 90.0 + grid.STEP / 2
    crossings = (
        spans.filter((F.col("lat1") != F.col("lat2")) & (lo_lat <= centre) & (hi_lat > centre))
        # last column whose centroid lies strictly west of the crossing
        .select("polygon_id", "row", (F.ceil((lon_at(centre) + 180.0) / grid.STEP - 0.5) - 1).alias("last_col"))
        .groupBy("polygon_id", "row", "last_col").agg(F.count("*").alias("n"))
    )
    east = Window.partitionBy("polygon_id", "row").orderBy(F.desc("last_col"))
    runs = crossings.select(
        "polygon_id", "row", "last_col",
        F.sum("n").over(east).alias("crossed"),
        F.coalesce(F.lead("last_col").over(east), F.lit(-1)).alias("next_col"),
    ).filter("crossed % 2 = 1 AND last_col >= 0")
    inside = runs.select("row", F.explode(F.sequence(
        F.greatest(F.col("next_col") + 1, F.lit(0)), F.least("last_col", F.lit(grid.COLUMNS - 1)))).alias("col"))

    # Boxes an edge passes through: clip the edge to the row, then take the columns it spans.
    south = F.col("row") * grid.STEP - 90.0
    north = south + grid.STEP
    at = lambda lat: F.when(F.col("lat1") == F.col("lat2"), F.lit(None)).otherwise(
        lon_at(F.least(F.greatest(lat, lo_lat), hi_lat)))
    west_end = F.coalesce(F.least(at(south), at(north)), F.least("lon1", "lon2"))
    east_end = F.coalesce(F.greatest(at(south), at(north)), F.greatest("lon1", "lon2"))
    col_of = lambda lon: F.floor((lon + 180.0) / grid.STEP)
    touched = spans.select("row", F.explode(F.sequence(col_of(west_end), col_of(east_end))).alias("col"))

    # an edge at longitude 180 or latitude 90 touches no cell beyond it
    on_grid = F.col("row").between(0, grid.ROWS - 1) & F.col("col").between(0, grid.COLUMNS - 1)
    kept = inside.unionByName(touched).filter(on_grid).distinct().select(
        grid.cell_at(F.col("row"), F.col("col")).alias(CELL))
    return cells.join(kept, CELL, "left_semi")

"""Polygons cut along the cells of the grid: the clipped rings of each cell and the share of it they cover.

A ring is halved along a grid line again and again, first by rows and then by columns, until each piece lies in
one cell. A piece carries only its own vertices, so a ring of v vertices costs about v times the logarithm of
the rows and columns it spans, not v times its cells. Halving is a projection: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.functions import grid
from celltide.schemas import CELL

#: Halvings after which any span of rows, or of columns, is down to one.
ROW_HALVINGS = (grid.ROWS - 1).bit_length()
COLUMN_HALVINGS = (2 * grid.COLUMNS - 1).bit_length()  # a ring over the date line may reach past the last column
#: Covered share of a cell below which a polygon only touches it.
TOUCH = 1e-12


def rings(points: DataFrame) -> DataFrame:
    """Vertex lists (polygon_id, ring, hole, points) from rows (polygon_id, ring, hole, seq, lon, lat).

    ``ring`` tells the rings of a polygon apart and ``hole`` marks those that cut out of it; vertices follow ``seq`` and may run
    either way round. A last vertex equal to the first is dropped. A step of more than half the globe, such as from 179 to -179, crosses
    the date line, and the ring goes on past 180 or -180 in one piece; one from -180 to 180 is an edge along a parallel. Rows with a null coordinate are left out. Rings around a pole
    have to be closed along the 90th parallel.
    """
    of_ring = Window.partitionBy("polygon_id", "ring")
    along = of_ring.orderBy("seq")
    known = points.filter("lon IS NOT NULL AND lat IS NOT NULL")
    step = F.col("lon") - F.lag("lon").over(along)
    turn = F.when((F.abs(step) > 180.0) & (F.abs(step) < 360.0), F.signum(step)).otherwise(F.lit(0.0))
    unrolled = known.withColumn("_turn", turn).withColumn(
        "lon", F.col("lon") - 360.0 * F.sum("_turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    vertex = F.struct("seq", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    listed = unrolled.groupBy("polygon_id", "ring").agg(F.bool_or("hole").alias("hole"), F.array_sort(F.collect_list(vertex)).alias("_v"))
    line = F.transform("_v", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    return listed.select("polygon_id", "ring", F.coalesce("hole", F.lit(False)).alias("hole"), line.alias("points")).withColumn(
        "points", F.when(closed & (F.size("points") > 1), F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")))


def _next(points: Column) -> Column:
    """Each vertex's successor around the ring."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def cut(points: Column, axis: str, at: Column, below: bool) -> Column:
    """The part of a ring on one side of a grid line; what the line cuts off is closed along it."""
    other = "lat" if axis == "lon" else "lon"
    inside = lambda v: (v[axis] <= at) if below else (v[axis] >= at)

    def step(a: Column, b: Column) -> Column:
        across = a[other] + (b[other] - a[other]) * ((at - a[axis]) / (b[axis] - a[axis]))
        crossing = F.struct(*[(at if name == axis else across).cast("double").alias(name) for name in ("lon", "lat")])
        return (
            F.when(inside(a) & inside(b), F.array(a)).when(inside(a), F.array(a, crossing))
            .when(inside(b), F.array(crossing)).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))
        )

    return F.flatten(F.zip_with(points, _next(points), step))


def _halved(pieces: DataFrame, axis: str, first: str, last: str, origin: float) -> DataFrame:
    """Pieces of more than one row (or column) in two, the others as they are."""
    middle = F.floor((F.col(first) + F.col(last) + 1) / 2)
    line = middle * grid.STEP - origin
    part = lambda a, b, points: F.struct(a.cast("long").alias(first), b.cast("long").alias(last), points.alias("points"))
    halves = F.when(F.col(first) == F.col(last), F.array(part(F.col(first), F.col(last), F.col("points")))).otherwise(F.array(
        part(F.col(first), middle - 1, cut(F.col("points"), axis, line, True)),
        part(middle, F.col(last), cut(F.col("points"), axis, line, False))))
    rest = [c for c in pieces.columns if c not in (first, last, "points")]
    return pieces.select(*rest, F.inline(halves)).filter(F.size("points") >= 3)


def _span(pieces: DataFrame, axis: str, first: str, last: str, origin: float) -> DataFrame:
    """Add the first and last row (or column) that a piece reaches; a piece that ends on a line doesn't reach past it."""
    ends = F.transform("points", lambda v: (v[axis] + origin) / grid.STEP)
    low = F.floor(F.array_min(ends))
    return pieces.withColumns({first: low, last: F.greatest(low, F.ceil(F.array_max(ends)) - 1)})


def ring_area(points: Column) -> Column:
    """Area within a ring in square degrees, whichever way round it runs."""
    base = F.element_at(points, 1)
    term = lambda a, b: (
        (a["lon"] - base["lon"]) * (b["lat"] - base["lat"]) - (b["lon"] - base["lon"]) * (a["lat"] - base["lat"]))
    return F.abs(F.aggregate(F.zip_with(points, _next(points), term), F.lit(0.0), lambda x, y: x + y)) / 2


def clipped_rings(vertex_lists: DataFrame) -> DataFrame:
    """(polygon_id, ring, hole, cell, points, area) of every cell that a ring covers a part of."""
    pieces = _span(vertex_lists.filter(F.size("points") >= 3), "lat", "_r0", "_r1", 90.0)
    for _ in range(ROW_HALVINGS):
        pieces = _halved(pieces, "lat", "_r0", "_r1", 90.0)
    pieces = _span(pieces, "lon", "_c0", "_c1", 180.0)
    for _ in range(COLUMN_HALVINGS):
        pieces = _halved(pieces, "lon", "_c0", "_c1", 180.0)
    on_grid = F.col("_r0").between(0, grid.ROWS - 1)
    return pieces.filter(on_grid).select(
        "polygon_id", "ring", "hole", grid.cell_at(F.col("_r0"), F.pmod(F.col("_c0"), F.lit(grid.COLUMNS))).alias(CELL),
        "points", ring_area(F.col("points")).alias("area"))


def clip_shapes(cells: DataFrame, vertex_lists: DataFrame) -> DataFrame:
    """The part of each cell that lies inside each polygon: (cell, polygon_id, share, rings).

    ``share`` is the covered part of the cell's box in degrees, 1 for a cell wholly inside. ``rings`` are the clipped rings with their
    ``hole`` flags; where a ring leaves and re-enters a cell its parts hang together along the cell's border, which adds
    no area. Cells that a polygon only touches are left out, and so are cells not in ``cells``. A polygon's rings must
    not cross each other.
    """
    parts = clipped_rings(vertex_lists).join(cells.select(CELL).distinct(), CELL, "left_semi")
    covered = parts.groupBy(CELL, "polygon_id").agg(
        (F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))) / (grid.STEP * grid.STEP)).alias("share"),
        F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))).alias("_rings"))
    return covered.filter(F.col("share") > TOUCH).select(
        CELL, "polygon_id", "share",
        F.transform("_rings", lambda r: F.struct(r["hole"].alias("hole"), r["points"].alias("points"))).alias("rings"))


def shape_wkt(shape_rings: Column) -> Column:
    """Clipped rings as well-known text, one POLYGON per outer ring or hole, for tools that draw them."""
    pair = lambda v: F.format_string("%.6f %.6f", v["lon"], v["lat"])
    ring = lambda r: F.concat(
        F.lit("(("), F.array_join(F.transform(F.concat(r["points"], F.slice(r["points"], 1, 1)), pair), ", "), F.lit("))"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(F.filter(shape_rings, lambda r: ~r["hole"]), ring), ", "), F.lit(")"))

"""The global half-degree grid: 720 columns, ids counted from 1 at the south-west corner."""

from pyspark.sql import Column, functions as F

COLUMNS = 720
ROWS = 360
STEP = 0.5


def cell_id(lat: Column, lon: Column) -> Column:
    row = F.floor((lat + F.lit(90.0)) / F.lit(STEP))
    col = F.floor((lon + F.lit(180.0)) / F.lit(STEP))
    return (row * F.lit(COLUMNS) + col + F.lit(1)).cast("long")


def cell_at(row: Column, col: Column) -> Column:
    """Id of the cell in zero-based grid row ``row`` and column ``col``."""
    return (row * F.lit(COLUMNS) + col + F.lit(1)).cast("long")


def cell_row(cell: Column) -> Column:
    return F.floor((cell - 1) / F.lit(COLUMNS)).cast("long")


def cell_col(cell: Column) -> Column:
    return F.pmod(cell - 1, F.lit(COLUMNS)).cast("long")


def cell_south(cell: Column) -> Column:
    return cell_row(cell) * F.lit(STEP) - F.lit(90.0)


def cell_west(cell: Column) -> Column:
    return cell_col(cell) * F.lit(STEP) - F.lit(180.0)


def centroid_lat(cell: Column) -> Column:
    return cell_south(cell) + F.lit(STEP / 2)


def centroid_lon(cell: Column) -> Column:
    return cell_west(cell) + F.lit(STEP / 2)


def cell_wkt(cell: Column) -> Column:
    south, west = cell_south(cell), cell_west(cell)
    north, east = south + F.lit(STEP), west + F.lit(STEP)
    corner = lambda x, y: F.format_string("%.2f %.2f", x, y)
    ring = F.concat_ws(
        ", ", corner(west, south), corner(east, south), corner(east, north),
        corner(west, north), corner(west, south),
    )
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))

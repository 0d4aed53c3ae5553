"""Point labels from map snapshots, and their cell-month panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from celltide import fixed_values as fixed
from celltide.functions import dates, grid, text
from celltide.functions.values import map_values
from celltide.operators import panel as ops
from celltide.operators.dedup import last_per_period
from celltide.operators.votes import majority_vote
from celltide.runtime import checkpoint
from celltide.schemas import CELL, PERIOD


def revisions_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per revision from JSON documents that list revisions per page."""
    schema = "query struct<pages: array<struct<revisions: array<struct<revid: long, timestamp: string, comment: string>>>>>"
    parsed = documents.select(F.from_json(F.col(column), schema).alias("d"))
    pages = parsed.select(F.explode("d.query.pages").alias("page"))
    return pages.select(F.inline("page.revisions"))


def monthly_revisions(revisions: DataFrame) -> DataFrame:
    """The last revision of every calendar month."""
    timed = revisions.withColumn("_ts", dates.iso_timestamp(F.col("timestamp")))
    return last_per_period(timed, "_ts", dates.month_of(F.col("_ts")), "revid").drop("_ts")


def extract_entries(df: DataFrame, content: str, block: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per block found in the text, with each field's first capture (NULL when absent)."""
    blocks = df.withColumn("_block", F.explode(text.all_groups(F.col(content), block)))
    return blocks.withColumns({n: text.group_of(F.col("_block"), p) for n, p in fields.items()}).drop("_block", content)


BLANKS = " \t\n\r\x0b\x0c"
#: ``key = value`` in a map entry; a value is quoted or ends at a comma.
PAIR = r'(\w+)\s*=\s*("[^"]*"|[^,"]*)'


def marker_entries(df: DataFrame, content: str) -> DataFrame:
    """One row per brace entry with its lat, long, mark and label as text; NULL where an entry lacks one.

    An entry is a list of ``key = value`` pairs, of which the first of a name counts. A label may be a link
    ``[[target|shown]]``, of which the target counts.
    """
    entries = df.withColumn("_entry", F.explode(text.all_groups(F.col(content), r"\{([^{}]*)\}")))
    pairs = entries.withColumns({
        "_keys": text.all_groups(F.col("_entry"), PAIR, 1), "_values": text.all_groups(F.col("_entry"), PAIR, 2),
    })
    value = lambda key: F.get("_values", (F.array_position("_keys", key) - 1).cast("int"))
    quoted = lambda key: F.nullif(F.regexp_extract(value(key), '^"(.+)"$', 1), F.lit(""))
    label = F.regexp_extract(value("label"), r'^"?\[*([^\]|"]*)', 1)
    return pairs.withColumns({
        "lat": quoted("lat"), "lon": quoted("long"), "mark": quoted("mark"), "label": F.nullif(label, F.lit("")),
    }).drop("_entry", "_keys", "_values", content)


def parse_snapshots(
    revisions: DataFrame, marks: Mapping[str, tuple] = fixed.MARKS, skipped: Sequence[str] = fixed.SKIPPED_MARKS,
) -> DataFrame:
    """Point labels of each month's last revision.

    Entries without position or icon, with an unreadable number or a skipped icon, are left out; an
    unknown icon is kept as unknown.
    """
    entries = marker_entries(monthly_revisions(revisions), "content")
    mark = F.col("mark")
    placed = entries.withColumns({
        "mark": F.btrim(mark, F.lit(BLANKS)), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"),
    }).filter("mark IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").filter(~mark.isin(list(skipped)))
    part = lambda i: {name: meaning[i] for name, meaning in marks.items()}
    return placed.select(
        F.to_date(dates.iso_timestamp(F.col("timestamp"))).alias("date"), "lat", "lon",
        F.coalesce(F.btrim("label", F.lit(BLANKS)), F.lit("")).alias("location_name"),
        map_values(mark, part(0), "unknown").alias("control_status"),
        F.coalesce(map_values(mark, part(1)), F.concat(F.lit("UNMAPPED:"), mark)).alias("actor"),
        F.lit(fixed.SNAPSHOT_SOURCE).alias("source"),
        map_values(mark, part(2), "low").alias("confidence"),
    )


def place_points(points: DataFrame, statuses: Sequence[str] = fixed.LABEL_STATUSES) -> DataFrame:
    """Points with a territorial status, with their cell and month."""
    return points.filter(F.col("control_status").isin(list(statuses))).withColumns({
        CELL: grid.cell_id(F.col("lat"), F.col("lon")), PERIOD: dates.month_of(F.col("date")),
    })


def labels_to_panel(points: DataFrame, periods: Column, statuses: Sequence[str] = fixed.LABEL_STATUSES) -> DataFrame:
    """Majority label per cell and month, carried forward over ``periods`` (an array of months).

    Months before a cell's first label are dropped. ``is_direct_snapshot`` says whether any cell
    was labelled that month, ``is_cell_snapshot`` whether this one was.
    """
    votes = checkpoint(majority_vote(place_points(points, statuses)))  # bounded by the grid, used three times
    labelled_months = ops.observed_periods(votes)
    dense = ops.densify(votes, periods).withColumn("is_cell_snapshot", F.col("control_status").isNotNull())
    filled = ops.carry_forward(dense, ["control_status", "label_confidence", "n_towns_in_cell", "high_conf_towns"])
    return (
        filled.na.drop(subset=["control_status"])
        .withColumn("is_direct_snapshot", F.array_contains(labelled_months, F.col(PERIOD)))
    )

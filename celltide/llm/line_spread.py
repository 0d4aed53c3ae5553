"""Cross-site boilerplate: lines that recur on many distinct sites.

Each line's spread is the number of distinct sites it stands on. HyperLogLog sketches of the sites, one per
line, merge by aggregation, so a line with a third of all rows leaves each task as one small sketch. Lines
whose estimate is near the threshold, on either side, are counted exactly; the others are decided by the
sketch. A line keeps its first occurrence and goes from everywhere else.

A copied document carries each of its lines to all sites of its copies, which near-duplicate removal is for.
A line must therefore also stand in as many different texts as it needs sites; texts are
sketched and counted like sites. Neighbouring lines play no part.

All of it is native: expressions, aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from celltide.runtime import checkpoint

#: Distinct sites from which on a line is boilerplate; bits of the sketch (2^10 registers, 3.3 % standard error).
MIN_SITES, SKETCH_BITS = 10, 10
#: Standard errors around the threshold inside which lines are counted exactly.
NEAR = 4.0


def _row_key() -> Column:
    """Tells rows of the documents apart; equal rows share it and are treated alike."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h1"), F.hash("text", F.lit(1)).alias("h2"))


def _line_key(line: Column) -> Column:
    """96 bits of a line; null for blank lines, which are never boilerplate."""
    return F.when(F.btrim(line, F.lit(" \t\r\x0b\x0c")) != "", F.struct(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, site, place, line) of every line that isn't blank: hashes only, no text."""
    parts = F.split(F.col("text"), "\n", -1)
    keyed = docs.select(
        _row_key().alias("row"), F.col("source").alias("site"),
        F.transform(parts, lambda p: _line_key(p)).alias("keys"),
    )
    return keyed.select("row", "site", F.posexplode("keys").alias("place", "line")).filter("line IS NOT NULL")


def _counted(held: DataFrame, near: DataFrame, what: str) -> DataFrame:
    """(line, exact number of distinct values of ``what``) of the lines in ``near``."""
    found = held.join(near, "line", "left_semi").select("line", what).distinct()
    return found.groupBy("line").agg(F.count("*").alias(f"counted_{what}"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(line, sites, exact, first_row, first_place) of all lines on at least ``min_sites`` sites and in as many different texts.

    ``sites`` is the exact number where ``exact`` is true, else the sketch's estimate. A null site is a
    site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("null"))
    held = checkpoint(lines_of(docs).groupBy(
        "line", site.alias("site"), F.struct("row.h1", "row.h2").alias("text"),
    ).agg(F.min(F.struct("row.doc_id", "place")).alias("first")))
    row = F.struct("first.doc_id", "text.h1", "text.h2")
    error = NEAR * 1.04 / 2 ** (sketch_bits / 2)
    sketch = lambda what: F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(what), sketch_bits))
    # a line in few places needs no exact count
    known = checkpoint(held.groupBy("line").agg(
        sketch("site").alias("site"), sketch("text").alias("text"), F.count("*").alias("n"),
        F.min(F.struct(row.alias("row"), "first.place")).alias("first"),
    ).filter((F.col("n") >= min_sites) & (F.least("site", "text") >= min_sites * (1 - error) - 1)))
    near = lambda what: known.filter(F.col(what) <= min_sites * (1 + error) + 1).select("line")
    for what in ("site", "text"):
        known = known.join(_counted(held, near(what), what), "line", "left")
    return known.withColumn("sites", F.coalesce("counted_site", "site")).filter(
        (F.col("sites") >= min_sites) & (F.coalesce("counted_text", "text") >= min_sites),
    ).select(
        "line", "sites", F.col("counted_site").isNotNull().alias("exact"),
        F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` without repeated boilerplate lines, plus ``n_lines`` and ``n_removed``.

    Every row stays; a null text stays null with no lines, an empty one has one blank line. Lines are
    split at line feeds, whole and unlimited; blank lines stay. Equal rows are treated alike, so a row
    repeated with its id keeps its first occurrences too. The new names replace columns of the same name.
    """
    docs = docs.drop("n_lines", "n_removed")
    spread = checkpoint(spread_lines(docs, min_sites, sketch_bits))
    gone = lines_of(docs).join(spread, "line").filter(
        ~(F.col("row").eqNullSafe(F.col("first_row")) & (F.col("place") == F.col("first_place"))),
    ).groupBy("row").agg(F.collect_set("place").alias("_gone")).select(
        F.col("row.doc_id").alias("_id"), F.col("row.h1").alias("_h1"), F.col("row.h2").alias("_h2"), "_gone",
    )
    parts = F.split(F.col("text"), "\n", -1)
    keyed = docs.withColumn("_row", _row_key())
    joined = keyed.join(
        gone, keyed["_row.doc_id"].eqNullSafe(gone["_id"]) & (keyed["_row.h1"] == gone["_h1"]) & (keyed["_row.h2"] == gone["_h2"]), "left",
    )
    kept = F.filter(parts, lambda line, place: ~F.array_contains(F.col("_gone"), place))
    return joined.withColumns({
        "n_lines": F.coalesce(F.array_size(parts), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }).select(*docs.columns, "n_lines", "n_removed")

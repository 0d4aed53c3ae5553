"""Scans: typed CSV, several labelled sources, snapshots, and column-name tolerant reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from celltide import fixed_values as fixed, schemas

# Spellings that a CSV cell may use for "no value".
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def available_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header alone."""
    return spark.read.option("header", True).csv(path).columns


def scan_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[c for c in wanted if c in present])


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``; a missing one is NULL, a value that does not fit is NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    def fit(f: T.StructField) -> Column:
        if f.name not in kinds:
            return F.lit(None).cast(f.dataType)
        return F.col(f.name) if kinds[f.name] == f.dataType else F.col(f.name).try_cast(f.dataType)
    return df.select(*[fit(f).alias(f.name) for f in schema.fields])


def read_csv_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True,
) -> DataFrame:
    """CSV by header name into ``schema``; columns may be missing, extra or in any order.

    Quoted fields may hold line breaks, so a file is read by one task. For large files use ``read_large_csv``, or pass
    ``multi_line=False`` where every record is one line.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("encoding", "UTF-8").option("escape", '"').csv(path)
    )
    return _typed(raw, schema)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    wanted = scan_columns(raw, schema.fieldNames())
    cleaned = wanted.select(*[
        F.when(~F.trim(F.col(c)).isin(NULL_SPELLINGS), F.col(c)).alias(c) for c in wanted.columns
    ])
    return align_schema(cleaned, schema)


@dataclass(frozen=True)
class Source:
    """One input of a merged scan: a CSV or parquet path, or a DataFrame, and its label."""

    data: str | DataFrame
    label: str


def read_large_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """What ``read_csv_table`` gives, with files split among tasks although quoted fields may hold line breaks.

    A line begins a record where an even number of quotes stands before it in its file. Quotes are counted per block of a file; the
    few block totals give each block's parity, so every task finds its own records, and only a record that
    crosses blocks brings lines of several together. All files have the header of the first.
    """
    names = available_columns(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), quotes.cast("long").alias("quotes"))
    in_block = Window.partitionBy("file", "block").orderBy("line")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("quotes").over(earlier(in_block)), F.lit(0))
    # records that begin in a block, for either parity that it may begin with
    counted = lines.withColumn("upto", upto).withColumns({
        f"n{k}": F.sum(F.when((F.col("upto") + k) % 2 == 0, 1).otherwise(0)).over(in_block) for k in (0, 1)})
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("total"))
    by_file = Window.partitionBy("file").orderBy("block")  # as many rows as a file has blocks
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("total").over(earlier(by_file)), F.lit(0)) % 2).alias("parity"))
    placed = counted.join(blocks, ["file", "block"]).withColumn("n", F.when(F.col("parity") == 0, F.col("n0")).otherwise(F.col("n1")))
    held = placed.groupBy("file", "block").agg(F.max("n").alias("records"))
    former = lambda c: F.last(F.when(F.col("records") > 0, F.col(c)), ignorenulls=True).over(earlier(by_file))
    open_before = held.select("file", "block", former("block").alias("of_block"), former("records").alias("of_record"))
    carried = placed.join(open_before, ["file", "block"])
    own = F.col("n") > 0
    whole = carried.groupBy(
        "file", F.when(own, F.col("block")).otherwise(F.col("of_block")).alias("at"), F.when(own, F.col("n")).otherwise(F.col("of_record")).alias("record"),
    ).agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("l"))
    text = F.rtrim(F.array_join("l.value", "\n"), F.lit("\r"))
    records = whole.filter("NOT (at = 0 AND record = 1)").select(text.alias("text")).filter("text <> ''")
    kind = ", ".join(f"`{c}` STRING" for c in names)
    return _typed(records.select(F.from_csv("text", F.lit(kind), {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*"), schema)


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that do not exist. Nothing is read."""
    missing = []
    for path in paths:
        try:
            spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    return missing


def union_sources(
    spark: SparkSession, sources: Sequence[Source], schema: T.StructType = schemas.EVENTS,
    keep: Column | None = None, label_column: str = "data_source",
) -> DataFrame:
    """All sources aligned to one schema, filtered at their scans and labelled with their origin.

    All paths are checked first, and every missing one is named.
    """
    missing = missing_paths(spark, [s.data for s in sources if isinstance(s.data, str)])
    if missing:
        raise FileNotFoundError(f"missing source files: {missing}")

    def load(source: Source) -> DataFrame:
        if isinstance(source.data, DataFrame):
            return align_schema(source.data, schema)
        if source.data.rstrip("/").endswith(".parquet"):
            return align_schema(spark.read.parquet(source.data), schema)
        return read_csv_table(spark, source.data, schema)

    def labelled(source: Source) -> DataFrame:
        df = load(source)
        df = df if keep is None else df.filter(keep)
        return df.withColumn(label_column, F.lit(source.label))

    return reduce(DataFrame.unionByName, [labelled(s) for s in sources])


def latest_snapshot(df: DataFrame, file_name: Column, pattern: str = fixed.SNAPSHOT_FILE_DATE) -> DataFrame:
    """Only the rows whose file carries the newest date in its name.

    The newest date comes from a scalar subquery over the file names, not from a join.
    """
    dated = df.withColumn("_snapshot", F.regexp_extract(file_name, pattern, 1))
    newest = dated.filter(F.col("_snapshot") != "").agg(F.max("_snapshot")).scalar()
    return dated.filter(F.col("_snapshot") == newest).drop("_snapshot")


def read_latest_csv(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All CSV files of a folder's newest day, chosen by file name before any content is read."""
    listing = spark.read.format("binaryFile").load(folder).select("path")
    day = F.regexp_extract(F.element_at(F.split("path", "/"), -1), fixed.SNAPSHOT_FILE_DATE, 1)
    dated = listing.withColumn("day", day).filter(F.col("day") != "")
    newest = dated.agg(F.max("day")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no dated file in {folder}")
    files = dated.filter(F.col("day") == newest).orderBy("path").collect()  # names of one day's files
    return read_csv_table(spark, [r["path"] for r in files], schema)


def normalize_key(df: DataFrame, aliases: Sequence[str] = ("priogrid_gid", "gid"), to: str = schemas.CELL) -> DataFrame:
    """Rename the first alias present to ``to``."""
    for name in aliases:
        if name in df.columns:
            return df.withColumnRenamed(name, to)
    raise ValueError(f"none of {list(aliases)} among {df.columns}")


def ranked_features(df: DataFrame, top: int | None = None) -> list[str]:
    """Feature names in rank order from a table with a ``feature`` column (a short list by nature)."""
    if "feature" not in df.columns:
        raise ValueError(f"expected a 'feature' column, got {df.columns}")
    ordered = df.orderBy("rank") if "rank" in df.columns else df
    ordered = ordered.select("feature")
    return [r["feature"] for r in (ordered if top is None else ordered.limit(top)).toLocalIterator()]

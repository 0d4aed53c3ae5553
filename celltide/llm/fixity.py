"""Fixity audit of WARC replicas with Merkle trees.

Every record is hashed where it lies. The hashes of a file's records go into a tree: its leaves are ordered ranges of
byte offsets, each inner node hashes the hashes of a fixed number of neighbouring ranges, the root stands for the
file. Two replicas compare roots; only below roots that differ are children compared, level by level, until the
ranges that hold the damage remain, and only their records are compared one by one. Intact files
cost one comparison each.

Everything is an aggregation or join over hashes; payloads are read once per replica and never shuffled. A node gathers at most
``2 ** FAN_BITS`` children and a leaf the records that begin within ``RANGE_BYTES``, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltide.llm.text import whole
from celltide.runtime import checkpoint

#: Bytes of a leaf's offset range and binary logarithm of a node's children.
RANGE_BYTES, FAN_BITS = 65_536, 4


def record_bytes(uri: Column, payload: Column) -> Column:
    """A WARC resource record; null parts count as empty."""
    body = F.encode(whole(payload), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), whole(uri),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def pack(records: DataFrame, order: list[str]) -> DataFrame:
    """``records`` (file, length, and ``order`` columns) with the ``offset`` that each has in its file."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, digest) of one replica from its ``records`` (file, offset, length, digest).

    Rows repeated at an offset become one whose digest covers all of them, so repeats differ from a single record.
    """
    grouped = records.groupBy("file", "offset").agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.coalesce("digest", F.lit("")))).alias("all"))
    return grouped.select("file", "offset", "length", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ","), 256)).alias("digest"))


def tree(leaf: DataFrame, range_bytes: int = RANGE_BYTES, fan_bits: int = FAN_BITS, height: int | None = None) -> list[DataFrame]:
    """Levels of the trees of all files, (file, node, hash) each, from offset ranges up to the roots.

    ``height`` makes two replicas' trees equally high; by default it follows the highest offset.
    """
    if height is None:
        height = tree_height([leaf], range_bytes, fan_bits)
    record = F.struct(F.col("offset"), F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").alias("said"))
    nodes = leaf.withColumn("node", F.floor(F.col("offset") / range_bytes)).groupBy("file", "node").agg(_hash(F.collect_list(record)))
    levels = [checkpoint(nodes)]
    for _ in range(height):
        child = F.struct(F.col("node"), F.concat_ws(":", F.col("node").cast("string"), "hash").alias("said"))
        above = levels[-1].select("file", F.shiftright("node", fan_bits).alias("up"), child.alias("child"))
        levels.append(checkpoint(above.groupBy("file", F.col("up").alias("node")).agg(_hash(F.collect_list("child")))))
    return levels


def _hash(parts: Column) -> Column:
    """Hash of the parts in the order of their first field."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: p["said"]), "\n"), 256).alias("hash")


def tree_height(replicas: list[DataFrame], range_bytes: int = RANGE_BYTES, fan_bits: int = FAN_BITS) -> int:
    """Levels above the leaves that the longest file of all replicas needs."""
    top = max((r.agg(F.max("offset")).first()[0] or 0 for r in replicas), default=0) // range_bytes
    return max(0, -(-int(top).bit_length() // fan_bits))


def _differing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key)


def damaged(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(file, offset, status) of all records in which two replicas' ``leaves`` differ.

    ``status`` is 'differs', 'missing in a' or 'missing in b'. Found by descending from the roots into differing
    branches only. A null file name is a file of its own; empty replicas are fine.
    """
    a, b = (checkpoint(r.withColumn("file", F.coalesce(F.concat(F.lit("="), "file"), F.lit("")))) for r in (a, b))
    height = tree_height([a, b], range_bytes, fan_bits)
    up_a, up_b = (tree(r, range_bytes, fan_bits, height) for r in (a, b))
    bad = checkpoint(_differing(up_a[-1], up_b[-1], ["file", "node"], "hash"))
    for level in range(height - 1, -1, -1):
        parents = bad.withColumnRenamed("node", "up")
        below = [t[level].withColumn("up", F.shiftright("node", fan_bits)).join(parents, ["file", "up"], "left_semi") for t in (up_a, up_b)]
        bad = checkpoint(_differing(*below, ["file", "node"], "hash"))
    inside = [
        r.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["file", "node"], "left_semi").select(
            "file", "offset", F.concat_ws(":", F.col("length").cast("string"), "digest").alias("said"))
        for r in (a, b)
    ]
    both = inside[0].withColumnRenamed("said", "a").join(inside[1].withColumnRenamed("said", "b"), ["file", "offset"], "full")
    status = F.when(F.col("a").isNull(), "missing in a").when(F.col("b").isNull(), "missing in b").otherwise("differs")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        F.when(F.col("file") != "", F.substring("file", 2, 1 << 30)).alias("file"), "offset", status.alias("status"),
    )

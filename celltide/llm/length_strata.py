"""Ranked lexical search over a length-stratified index.

All documents of one normaliser ``m`` form a stratum, so a term's impact depends on its frequency alone
there and is worked out once per frequency, not per document. A stratum is stored as blocks of bounded size; in
a block the postings of a term lie by frequency, as runs. The greatest frequency of each term bounds the
score that a query can reach in a block: each query visits the blocks with the highest bounds first, and
then only those whose bound reaches the score of its last place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from celltide.llm.text import whole
from celltide.runtime import checkpoint

#: Documents and terms (with repeats) of a block, about; bounds what one group holds. A longer text is a block of its own.
BLOCK_DOCS, BLOCK_TERMS = 1024, 500_000
#: Bytes of text whose terms lie in a task's memory together; a longer text is a share of its own.
SHARE_BYTES = 2_000_000
#: Rows of an Arrow batch of texts, and blocks of one of the index: what a task and its Python worker hold beside each other.
BATCH_TEXTS, BATCH_BLOCKS = 1000, 4
#: Queries that go through the index together.
ITEMS = 1024
#: Blocks that each query visits first, those with its highest bounds.
FIRST = 4
#: Cells (queries x documents) that are scored at once, and postings that are added to them at once.
CELLS, POSTINGS = 2_000_000, 250_000

#: Bytes of UTF-8 text to bytes of its terms: A-Z lower-cased; digits, a-z and all bytes outside ASCII stay; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms of a whole text in UTF-8: maximal runs of ASCII letters and digits and all characters outside ASCII."""
    return text.encode().translate(_LETTERS).split()


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term adds per weight, by its frequency in a document of normaliser ``m``."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Index:
    """Blocks of strata, and the totals of the corpus: documents with a term, and terms with repeats."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; by default one holds all blocks that a task reads."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- building ----------------------------------------------------------------------------------

@F.pandas_udf(LongType())
def _term_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([len(terms_of(t)) for t in batch], dtype="int64")


def _shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SHARE_BYTES`` of text."""
    part = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)) // SHARE_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, salt, text) to (doc_id, salt, n, terms, tfs), a share of the bytes at a time; texts without terms go.

    A document's distinct terms are one value, joined by blanks, which no term holds; their frequencies are another.
    """
    for batch in (share for whole_batch in batches for share in _shares(whole_batch)):
        n, terms, tfs, at = [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            counted = Counter(terms_of(text))
            if counted:
                terms.append(b" ".join(counted))
                tfs.append(_ints(np.fromiter(counted.values(), dtype="<i4", count=len(counted))))
                n.append(counted.total())
                at.append(row)
        kept = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([
            kept.column(0), kept.column(1), pa.array(n, pa.int64()),
            pa.array(terms, pa.binary()), pa.array(tfs, pa.binary()),
        ], names=["doc_id", "salt", "n", "terms", "tfs"])


def _ints(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _block(rows: pa.Table) -> pa.Table:
    """One block of a stratum: documents by id, and of each term its runs of equal frequency."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
    lists = pc.split_pattern(rows.column("terms").combine_chunks(), " ")
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    tf = np.frombuffer(b"".join(rows.column("tfs").to_pylist()), dtype="<i4").astype(np.int64)
    doc = pc.list_parent_indices(lists).to_numpy()
    key = code * (int(tf.max()) + 1) + tf
    order = np.argsort(key, kind="stable")
    code, tf, doc, key = code[order], tf[order], doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # where runs begin
    runs = np.bincount(code[first], minlength=len(coded.dictionary))
    df = np.bincount(code, minlength=len(coded.dictionary))
    one = lambda values, kind: pa.array([values], kind)
    return pa.table({
        "m": rows.column("m").slice(0, 1), "shard": rows.column("shard").slice(0, 1),
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("doc_id").combine_chunks()),
        "terms": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
        "df": one(_ints(df), pa.binary()), "top_tf": one(_ints(tf[np.cumsum(df) - 1]), pa.binary()),
        "runs": one(_ints(runs), pa.binary()), "run_tf": one(_ints(tf[first]), pa.binary()),
        "run_docs": one(_ints(np.diff(np.append(first, len(key)))), pa.binary()), "docs": one(_ints(doc), pa.binary()),
    })


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents with at least one term; null and empty texts have none. Repeated rows count each."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    with _batches_of(docs.sparkSession, BATCH_TEXTS):
        lengths = checkpoint(rows.select(_term_count("text").alias("n")).filter("n > 0").groupBy("n").agg(F.count("*").alias("docs")))
    totals = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    m = F.expr(f"CAST(75 + (CAST({25 * n_docs} AS BIGINT) * n) DIV {max(n_terms, 1)} AS BIGINT)")
    # a stratum's number of blocks; as few rows as there are lengths
    strata = checkpoint(lengths.groupBy(m.alias("m")).agg(F.greatest(
        F.ceil(F.sum("docs") / BLOCK_DOCS), F.ceil(F.sum(F.col("n") * F.col("docs")) / BLOCK_TERMS)).alias("shards")))
    counted = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("salt"), "text").mapInArrow(
        _frequencies, f"doc_id {kind}, salt long, n long, terms binary, tfs binary")
    placed = counted.withColumn("m", m).join(strata, "m").select(
        "m", F.pmod("salt", "shards").cast("int").alias("shard"), "doc_id", "terms", "tfs")
    blocks = placed.groupBy("m", "shard").applyInArrow(
        _block, f"m long, shard int, doc_ids array<{kind}>, terms array<binary>, df binary, top_tf binary, "
        "runs binary, run_tf binary, run_docs binary, docs binary")
    with _batches_of(docs.sparkSession, BATCH_TEXTS):
        return Index(checkpoint(blocks), n_docs, n_terms)


# --- searching ---------------------------------------------------------------------------------

class Queries:
    """A bounded number of queries: their terms, and entries (query, term, weight x repeats) by query."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        counted = [Counter(terms_of(t or "")) for _, t in items]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
        self.terms = pa.array(list(number), pa.binary())
        self.item = np.array([i for i, c in enumerate(counted) for _ in c], dtype=np.int64)
        self.term = np.array([number[t] for c in counted for t in c], dtype=np.int64)
        self.times = np.array([n for c in counted for n in c.values()], dtype=np.int64)
        self.weight = self.times

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        by_term = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(self.terms))], dtype=np.int64)
        self.weight = self.times * by_term[self.term]


def _from(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), dtype="<i4").astype(np.int64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def _places(queries: Queries, block: dict[str, pa.Scalar]) -> np.ndarray:
    """The number of each query term in a block, -1 where the block doesn't hold it."""
    return pc.fill_null(pc.index_in(queries.terms, value_set=block["terms"].values), -1).to_numpy().astype(np.int64)


def _bounds(queries: Queries, block: dict[str, pa.Scalar], places: np.ndarray) -> np.ndarray:
    """The score that no document of the block exceeds, per query."""
    at = places[queries.term]
    there = at >= 0
    best = impact(_from(block["top_tf"]), block["m"].as_py())
    out = np.zeros(len(queries.ids), dtype=np.int64)
    np.add.at(out, queries.item[there], queries.weight[there] * best[at[there]])
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _score(queries: Queries, block: dict[str, pa.Scalar], places: np.ndarray, items: np.ndarray, least: np.ndarray, k: int):
    """(query, document's number, score) of each query's best in a block, no fewer than ``least`` and above 0."""
    df, runs = _from(block["df"]), _from(block["runs"])
    tf_values, which = np.unique(_from(block["run_tf"]), return_inverse=True)
    by_run = impact(tf_values, block["m"].as_py())[which]  # worked out once per frequency of the stratum
    by_posting, docs = np.repeat(by_run, _from(block["run_docs"])), _from(block["docs"])
    begins, n = np.cumsum(df) - df, len(block["doc_ids"].values)
    for a in range(0, len(items), step := max(1, CELLS // n)):
        part = items[a:a + step]
        row = np.full(len(queries.ids), -1, dtype=np.int64)
        row[part] = np.arange(len(part))
        at = places[queries.term]
        used = np.flatnonzero((row[queries.item] >= 0) & (at >= 0) & (queries.weight > 0))
        scores, share = np.zeros(len(part) * n, dtype=np.int64), np.cumsum(df[at[used]]) // POSTINGS
        for some in np.split(used, np.flatnonzero(np.diff(share)) + 1):
            size, places_of = df[at[some]], _spread(begins[at[some]], df[at[some]])
            np.add.at(scores, np.repeat(row[queries.item[some]] * n, size) + docs[places_of], np.repeat(queries.weight[some], size) * by_posting[places_of])
        for i, of_item in zip(part, scores.reshape(len(part), n)):
            found = np.flatnonzero(of_item >= max(least[i], 1))
            if len(found) > k:
                found = found[of_item[found] >= np.partition(of_item[found], -k)[-k]]
            for d in found[np.argsort(-of_item[found], kind="stable")][:k]:  # equal scores by id, as the documents lie
                yield int(i), int(d), int(of_item[d])


def _collect_terms(index: Index, queries: Broadcast) -> dict[int, int]:
    """Documents that hold each term of the queries, over all blocks."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries.value.terms), dtype=np.int64)
        for block in _rows(batches):
            at = _places(queries.value, block)
            total[at >= 0] += _from(block["df"])[at[at >= 0]]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["term", "df"])

    found = index.blocks.select("terms", "df").mapInArrow(held, "term long, df long")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _best_blocks(index: Index, queries: Broadcast, first: int) -> list[tuple[int, int, int]]:
    """(query, m, shard) of the blocks with each query's highest bounds."""

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[int, int, int]]] = [[] for _ in queries.value.ids]
        for block in _rows(batches):
            of = _bounds(queries.value, block, _places(queries.value, block))
            for i in np.flatnonzero(of):
                held[i] = sorted([*held[i], (-int(of[i]), block["m"].as_py(), block["shard"].as_py())])[:first]
        flat = [(i, *x) for i, best in enumerate(held) for x in best]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], pa.int64()) for c in range(4)], names=["item", "below", "m", "shard"])

    found = index.blocks.select("m", "shard", "terms", "top_tf").mapInArrow(bounds, "item long, below long, m long, shard long")
    order = Window.partitionBy("item").orderBy("below", "m", "shard")
    best = found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= first)
    return [(r["item"], r["m"], r["shard"]) for r in best.collect()]


def _visit(index: Index, queries: Broadcast, least: np.ndarray, k: int, only: dict[tuple[int, int], list[int]] | None = None) -> DataFrame:
    """(item, doc_id, score): each task's best documents per query, from blocks whose bound reaches ``least``."""
    kind = index.blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, reached = queries.value, least.copy()
        held: list[list[int]] = [[] for _ in q.ids]
        for block in _rows(batches):
            places = _places(q, block)
            bound = _bounds(q, block, places)
            items = np.flatnonzero((bound >= reached) & (bound > 0))
            if only is not None:
                items = np.intersect1d(items, only[block["m"].as_py(), block["shard"].as_py()])
            found = list(_score(q, block, places, items, reached, k))
            for i, _, score in found:
                held[i].append(score)
            for i in {i for i, _, _ in found}:
                held[i] = sorted(held[i], reverse=True)[:k]
                if len(held[i]) == k:
                    reached[i] = max(reached[i], held[i][-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in found], pa.int64()), block["doc_ids"].values.take(pa.array([d for _, d, _ in found], pa.int64())),
                pa.array([s for _, _, s in found], pa.int64())], names=["item", "doc_id", "score"])

    blocks = index.blocks
    if only is not None:
        blocks = blocks.filter(F.concat_ws("/", "m", "shard").isin([f"{m}/{shard}" for m, shard in only]))
    return blocks.mapInArrow(visit, f"item long, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: Index, items: list[tuple[object, str | None]], k: int, first: int) -> tuple[DataFrame, Queries]:
    context = index.blocks.sparkSession.sparkContext
    queries = Queries(items)
    queries.weigh(index.n_docs, _collect_terms(index, context.broadcast(queries)))
    shared, least = context.broadcast(queries), np.zeros(len(items), dtype=np.int64)
    only: dict[tuple[int, int], list[int]] = {}
    for item, m, shard in _best_blocks(index, shared, first):
        only.setdefault((m, shard), []).append(item)
    if only:
        last = _ranked(_visit(index, shared, least, k, only), k).filter(F.col("rank") == k)
        for r in last.select("item", "score").collect():
            least[r["item"]] = r["score"]
    return checkpoint(_ranked(_visit(index, shared, least, k), k)), queries


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", first: int = FIRST) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal ones go by ascending doc_id, null last. Items without a term, null texts included,
    have no rows; repeated items have theirs each. Items go through the index in blocks of about ``ITEMS``.
    """
    spark: SparkSession = items.sparkSession
    kept = checkpoint(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")))
    parts, out = -(-kept.count() // ITEMS), []
    for part in range(parts):
        of = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        held = [(r["item_id"], r["text"]) for r in of.orderBy("item_id", "text").collect()]
        with _batches_of(spark, BATCH_BLOCKS):
            found, queries = _search_block(index, held, k, first)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"item long, item_id {kept.schema['item_id'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return index.blocks.select(
            F.lit(None).cast(kept.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("rank"),
            F.explode("doc_ids").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result

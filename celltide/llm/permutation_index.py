"""Nearest neighbours by a permutation index.

A few vectors are pivots. Every vector is represented by the pivots in order of nearness, and stands in the inverted
file of each of its nearest pivots together with the pivot's place in that order. A query reads the files of its
own nearest pivots and sums, per vector, how far the places differ: Spearman's footrule, where a pivot outside
the order counts as the place after the last. The vectors of least footrule are reranked by cosine.

The index is cut into shards by hash, so files stay of bounded size; a query's best of all shards are merged.
Reranking goes on past its base share while it is still inside the dense group that the best found lie in, so a
large group of near copies doesn't push true neighbours out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from celltide.llm.vectors import cosines, in_common_dimension, scaled, usable
from celltide.runtime import checkpoint

#: Pivots, how many of them a vector is posted under, vectors of a shard, queries of a block.
PIVOTS, NEAREST, SHARD, QUERIES = 128, 128, 4096, 1024
#: Share of a shard that is reranked, how many of a query's candidates at least (over all shards), and how far below the worst kept cosine the median of a further run of
#: candidates may lie for the reranking to go on.
RERANK, LEAST, SLACK = 0.06, 256, 0.1


def pick_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """At most ``n`` distinct vectors of unit length: the first in hash order, however many copies they have."""
    rows = vectors.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(n).collect()
    distinct = [tuple(r["embedding"]) for r in rows]
    found = scaled(np.array(distinct, dtype=float).reshape(len(distinct), -1)) if distinct else np.empty((0, 1))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def orders(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties by the pivot's number."""
    return np.argsort(-(scaled(rows) @ pivots.T), axis=1, kind="stable")[:, :nearest]


INDEX = "shard long, pivot int, vec_id long, embedding array<double>, slots array<int>, places array<int>"


def build_index(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST, shard_rows: int = SHARD) -> DataFrame:
    """The index of all usable ``vectors`` (vec_id, embedding): per shard one row for each vector, in slot order
    with a null ``pivot``, and one inverted file per pivot with the slots and places posted there."""
    shards = max(1, -(-vectors.count() // shard_rows))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)))

    def post(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
        order = orders(np.stack(rows["embedding"].to_numpy()), pivots, nearest)
        slot, place = np.divmod(np.arange(order.size), order.shape[1])
        by_pivot = np.argsort(order.ravel(), kind="stable")
        cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
        files = [by_pivot[a:b] for a, b in zip(cuts, cuts[1:])]
        n = len(pivots)
        return pd.concat([
            pd.DataFrame({"shard": key[0], "pivot": None, "vec_id": rows["vec_id"], "embedding": rows["embedding"], "slots": None, "places": None}),
            pd.DataFrame({"shard": [key[0]] * n, "pivot": range(n), "vec_id": None, "embedding": None,
                          "slots": [slot[f].astype("int32") for f in files], "places": [place[f].astype("int32") for f in files]}),
        ]).astype({"pivot": "Int32", "vec_id": "Int64"})

    return placed.groupBy("shard").applyInPandas(post, INDEX)


def search(
    index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, nearest: int = NEAREST, rerank: float = RERANK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each of ``queries`` (vec_id, embedding).

    A query's own id is no candidate. Nearest first, ties to the smaller id; fewer than ``k`` if there are fewer.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks).cast("long"))
    asked = queries.select("vec_id", "embedding", block.alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    files = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(key: tuple, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = shard[shard["pivot"].isna()]
        if len(rows) and len(asked):
            ids, stored = rows["vec_id"].to_numpy(dtype="int64"), np.stack(rows["embedding"].to_numpy())
            # slots count the vectors in id order
            at = np.argsort(ids, kind="stable")
            ids, stored = ids[at], stored[at]
            files = shard[shard["pivot"].notna()][["pivot", "slots", "places"]]
            # the files side by side: a vector that isn't in one has that pivot at the place after the last
            posted = np.full((len(pivots), len(ids)), nearest, dtype=np.int16)
            for p, s, q in files.itertuples(index=False):
                posted[int(p), s] = q
            run = max(k, int(np.ceil(rerank * len(ids))), -(-LEAST // shards))
            wanted = np.stack(asked["embedding"].to_numpy())
            for q_id, vector, order in zip(asked["vec_id"], wanted, orders(wanted, pivots, nearest)):
                out += [(q_id, *hit) for hit in _nearest(q_id, vector, order, ids, stored, posted, k, run)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = files.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        look, "query_id long, vec_id long, score double",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(q_id, vector, order, ids, stored, posted, k, run) -> list[tuple[int, float]]:
    """The ``k`` nearest of one shard, by footrule first and cosine then, ``run`` candidates at a time."""
    footrule = np.abs(posted[order] - np.arange(len(order), dtype=np.int16)[:, None]).sum(axis=0, dtype=np.int32)
    ranked = np.argsort(footrule, kind="stable")
    ranked = ranked[ids[ranked] != q_id]
    taken = np.empty(0, dtype=int)
    score = np.empty(0)
    for at in range(0, len(ranked), run):
        more = ranked[at:at + run]
        cosine = cosines(stored[more], vector)
        inside = at == 0 or np.median(cosine) >= np.sort(score)[-k:][0] - SLACK
        taken, score = np.concatenate([taken, more]), np.concatenate([score, cosine])
        if not inside:
            break
    top = np.lexsort((ids[taken], -score))[:k]
    return [(int(ids[taken[i]]), float(score[i])) for i in top]


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, nearest: int = NEAREST) -> DataFrame:
    """The ``k`` nearest of all other usable vectors for each one that ``is_query`` picks.

    Vectors that are null, zero, not finite, or of another dimension than most take no part, neither do rows
    without an id; repeated rows of an id and vector are one. An empty table gives an empty result.
    """
    usable_rows = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = checkpoint(in_common_dimension(usable_rows, "embedding").dropDuplicates(["vec_id", "embedding"]))
    chosen = pick_pivots(rows, pivots)
    index = checkpoint(build_index(rows, chosen, min(nearest, max(1, len(chosen)))))
    return search(index, rows.filter(is_query), chosen, k, min(nearest, max(1, len(chosen))))

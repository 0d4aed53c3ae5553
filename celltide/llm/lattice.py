"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to eight dimensions and decoded to the nearest point of
the E8 lattice, the densest packing there is in eight dimensions. The vector is posted in the cell of that point
and in the neighbouring cells that its projection leans to most, so two vectors meet if their cells overlap
in any table. What meets is verified by cosine.

A cell may hold a whole group of copies. Cells are therefore cut into blocks, and a task compares two blocks of
a cell by matrix products. No pairs are written: a comparison gives the number of links of each vector and the few
links that join the block's components. A pair that meets in several cells counts in the first of them only, which a
task knows from the cells that each vector carries. Exact copies are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from celltide.llm.blocks import by_block, runs
from celltide.llm.components import components
from celltide.llm.vectors import cosines, scaled, usable
from celltide.runtime import checkpoint

#: Tables, neighbouring cells per table, lattice cell size (for unit vectors), and vectors of a block.
TABLES, PROBES, SCALE, BLOCK = 8, 1, 0.25, 512


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 shifted by one half in every coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def shortest_e8() -> np.ndarray:
    """The 240 vectors from a lattice point to its nearest neighbours."""
    axes = np.eye(8)
    pairs = [s * axes[i] + t * axes[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = 0.5 - (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.array([*pairs, *signs[(signs < 0).sum(axis=1) % 2 == 0]])


def cells(rows: np.ndarray, tables: int, probes: int, scale: float, seed: int = 8) -> np.ndarray:
    """Number of each row's cells, (rows, tables * (1 + probes)), from unit vectors."""
    draw, around, out = np.random.default_rng(seed), shortest_e8(), []
    for _ in range(tables):
        # at least eight dimensions are needed for eight orthogonal directions
        plane = draw.standard_normal((rows.shape[1], 8))
        plane = np.linalg.qr(plane)[0] if rows.shape[1] >= 8 else plane / np.sqrt(8)
        number = draw.integers(1, 2**62, 9, dtype=np.int64)
        point = rows @ plane / scale + draw.random(8)
        home = nearest_e8(point)
        leaning = np.argsort(-((point - home) @ around.T), axis=1, kind="stable")[:, :probes]
        for cell in [home, *(home + around[leaning[:, p]] for p in range(probes))]:
            with np.errstate(over="ignore"):
                key = (np.rint(2 * cell).astype(np.int64) * number[:8]).sum(axis=1) + number[8]
                out.append(key ^ (key >> 31))
    return np.stack(out, axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def link_vectors(
    vectors: DataFrame, similarity: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one per row of ``vectors`` (vec_id, embedding, label).

    Only rows of an equal label that is not null link, by a cosine of at least ``similarity``; vectors that are
    null, zero or hold a null or non-finite component link with nothing, and vectors of different dimension never do.
    ``n_links`` counts other rows, so repeated rows link with each other. ``component_id`` is the least id
    reachable; a row without an id links, but never gives a component its id: alone, or among rows without ids only, its
    component is null, and such rows are not kept.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter(usable(F.col("embedding")) & F.col("label").isNotNull())
    copies = checkpoint(good.groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")).withColumn(
        "member", F.monotonically_increasing_id(),
    ))
    carried = checkpoint(_with_cells(copies, tables, probes, scale))
    blocks = _blocks(carried)
    found = checkpoint(by_block(blocks).mapInPandas(_comparing(similarity), "member long, other long, links long"))
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other IS NOT NULL").select(F.col("member").alias("a"), F.col("other").alias("b")))
    of = copies.join(links, "member", "left").join(joined, copies["member"] == joined["id"], "left").select(
        "label", "embedding", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component_id", "member").alias("component"),
    )
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(least, "component").select("label", "embedding", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    known = known.withColumnsRenamed({"label": "_label", "embedding": "_embedding"})
    out = rows.join(known, (rows["label"] == known["_label"]) & (rows["embedding"] == known["_embedding"]), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _with_cells(copies: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    @F.pandas_udf("array<long>")
    def posted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            size = batch.map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for i, c in zip(at, cells(_unit(np.stack(batch.iloc[at].to_numpy())), tables, probes, scale)):
                    out.iloc[i] = c
            yield out

    # vectors of different labels or dimensions are in different cells
    own = F.transform(F.array_distinct("cells"), lambda c: F.xxhash64(c, "label", F.size("embedding")))
    return copies.withColumn("cells", posted("embedding")).withColumn("cells", F.array_sort(own))


def _blocks(carried: DataFrame) -> DataFrame:
    """One row per vector and pair of blocks of a cell that it takes part in; cells of one vector are left out."""
    posts = carried.select("member", "weight", "embedding", "cells", F.explode("cells").alias("cell"))
    sizes = posts.select("cell").groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select(
        "cell", F.ceil(F.col("n") / BLOCK).alias("blocks"),
    )
    placed = posts.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    return placed.withColumn("with", other).select(
        F.xxhash64("cell", F.least("own", "with"), F.greatest("own", "with")).alias("block"),
        "cell", side.alias("side"), "member", "weight", "embedding", "cells",
    )


def _comparing(similarity: float):
    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (cell, side, member, weight, embedding, carried) in runs(batches):
            found = _links_of_block(cell[0], np.array(side), np.array(member), np.array(weight), np.stack(embedding), carried, similarity)
            if found is not None:
                yield found

    return compare


def _links_of_block(
    cell: int, side: np.ndarray, member: np.ndarray, weight: np.ndarray, rows: np.ndarray, carried: list, similarity: float,
) -> pd.DataFrame | None:
    """Links between the two sides of a block of a cell, or within it if there is one side only.

    ``side`` is 0 or 1 where two blocks meet and 2 where a block meets itself.
    """
    within = side[0] == 2
    left = np.arange(len(member)) if within else np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return None
    unit = _unit(rows)
    cosine = unit[left] @ unit[right].T
    if within:
        np.fill_diagonal(cosine, -2)
    linked = cosine >= similarity
    near = np.abs(cosine - similarity) < 1e-9
    if not (linked | near).any():
        return None
    for i, j in np.argwhere(near):  # decided without the product's rounding
        linked[i, j] = cosines(unit[right[j]][None, :], unit[left[i]])[0] >= similarity
    # an earlier cell that both carry has counted the pair
    before = [np.asarray(c)[np.asarray(c) < cell] for c in carried]
    earlier = {c: i for i, c in enumerate(np.unique(np.concatenate(before)).tolist())}
    has = np.zeros((len(member), len(earlier)), dtype=np.float32)
    for i, c in enumerate(before):
        has[i, [earlier[x] for x in c.tolist()]] = 1
    linked &= (has[left] @ has[right].T) < 0.5
    counts = np.zeros(len(member), dtype=np.int64)
    counts[left] += linked @ weight[right]
    if not within:
        counts[right] += linked.T @ weight[left]
    other = _forest(linked, left, right, len(member))
    some = counts > 0
    out = pd.DataFrame({"member": member, "other": pd.array(np.where(other >= 0, member[other], 0), dtype="Int64"), "links": counts})
    out.loc[other < 0, "other"] = pd.NA
    return out[some]


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each row of the block the least one of its component (-1 for itself): joins what is linked."""
    root = np.arange(n)
    while True:
        before = root.copy()
        # the least root among a row and what it is linked with, on both sides
        low = np.where(linked, root[right][None, :], n).min(axis=1)
        root[left] = np.minimum(root[left], low)
        low = np.where(linked, root[left][:, None], n).min(axis=0)
        root[right] = np.minimum(root[right], low)
        root = root[root]
        if (root == before).all():
            return np.where(root == np.arange(n), -1, root)

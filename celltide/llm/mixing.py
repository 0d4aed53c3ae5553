"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is wanted ``ratio = target / source size`` times. The whole part of the ratio
is taken as it is; the rest is an inclusion probability. The flight phase moves these probabilities along
null vectors of the balancing constraints (number of documents, number of tokens), so both totals stay
exactly where they were while one probability after the other reaches 0 or 1. With two constraints a
flight over any number of documents leaves at most two of them undecided.

Flights run over hashed blocks of bounded size in parallel; what they leave flies again, a thousand blocks
together, until one landing per source remains. A flight leaves a few documents of evenly spread sizes out,
so the landing has sizes to balance with; it tries every choice for its at most twelve documents and takes
the one that is nearest in tokens, then in documents. Only ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from celltide.llm.text import word_count
from celltide.operators.running import number_rows
from celltide.runtime import checkpoint

#: Documents of one first flight, and first blocks whose leftovers fly together.
BLOCK_ROWS, FAN_IN = 4096, 1024
#: Probabilities this near to 0 or 1 count as decided.
EPSILON = 1e-9
#: Documents of spread sizes that a flight leaves for the landing, beside the two it can't decide.
HELD = 10


def _null_vector(a: float, b: float, c: float) -> tuple[float, float, float]:
    """Direction in which three documents of these sizes keep their count and their tokens."""
    u = (c - b, a - c, b - a)
    return u if any(u) else (1.0, -1.0, 0.0)


def fly(size: np.ndarray, chance: np.ndarray, seed: str, held: int = HELD) -> np.ndarray:
    """Flight phase: the probabilities after all but at most ``held`` + 2 are 0 or 1.

    Count and token totals stay as they were; in expectation so does every single probability. Sizes come
    largest first; the ``held`` documents stay as they are and are spread evenly over that order.
    """
    draw, left, pool = random.Random(seed), chance.astype(float).tolist(), []
    sizes = size.astype(float).tolist()
    open_ = [i for i, p in enumerate(left) if EPSILON < p < 1 - EPSILON]
    kept = {open_[k * len(open_) // held] for k in range(held)} if len(open_) > held else set(open_)
    for i, p in enumerate(left):
        if not EPSILON < p < 1 - EPSILON:
            left[i] = float(round(p))
        elif i not in kept:
            pool.append(i)
        while len(pool) == 3:
            u = _null_vector(*(sizes[k] for k in pool))
            up = min((1 - left[k]) / v if v > 0 else left[k] / -v for k, v in zip(pool, u) if v)
            down = min(left[k] / v if v > 0 else (1 - left[k]) / -v for k, v in zip(pool, u) if v)
            step = up if draw.random() * (up + down) < down else -down
            for k, v in zip(pool, u):
                left[k] = min(1.0, max(0.0, left[k] + step * v))
            moved = [k for k in pool if EPSILON < left[k] < 1 - EPSILON]
            for k in pool:
                if k not in moved:
                    left[k] = float(round(left[k]))
            pool = moved
    return np.array(left)


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Settle the few undecided documents by the choice nearest in tokens, then in documents."""
    out, open_ = chance.copy(), np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON))
    if len(open_):
        choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
        off = choices - chance[open_]
        tokens, docs = np.abs(off @ size[open_]), np.abs(off.sum(axis=1))
        out[open_] = choices[np.lexsort((docs, np.round(tokens, 6)))[0]]
    return out


def source_targets(sources: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """``sources`` (source, source_size, one row each) with ``source_rank``, ``weight`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A
    target stops at ``max_repeat`` times the source's size; the excess is shared by weight among the others
    until none is above. The share of an uncapped source per weight only grows, so each turn is one
    aggregation over the sources and the state between turns is one number.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    stats = checkpoint(number_rows(sources, [F.col("source").asc_nulls_last()], "source_rank").withColumn("weight", turn))
    limit = F.col("source_size") * float(max_repeat)
    total, weight = stats.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, capped_before = float(total or 0), 0
    while weight:
        capped = F.col("weight") * rest / F.lit(weight) > limit
        n, fixed, open_weight = stats.agg(
            F.count_if(capped), F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("weight"))),
        ).first()
        if n == capped_before or not open_weight:
            break
        capped_before, rest, weight = n, float(total) - (fixed or 0.0), open_weight
    share = F.col("weight") * F.lit(rest) / F.lit(float(weight or 1.0))
    return stats.withColumn("target", F.when(share > limit, limit).otherwise(share))


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    Equal rows of ``doc_id``, ``source`` and size are decided together, null ids and sources included, so
    reruns and any partitioning agree. Null or empty texts have size 0 and take part in the document
    balance only. Other columns are kept; the four new names replace columns of the same name.
    An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    units = checkpoint(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    per_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"),
    )
    per_source = source_targets(per_source, weights, max_repeat).withColumn(
        "ratio", F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")),
    ).drop("weight")
    decided = _decide(units, per_source, seed)
    decided = decided.withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"})
    joined = docs.join(
        decided,
        docs["doc_id"].eqNullSafe(decided["_id"]) & docs["source"].eqNullSafe(decided["_source"])
        & (docs["size"] == decided["_size"]),
    )
    return joined.drop("_id", "_source", "_size")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the columns that ``mix`` added."""
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.drop("_copy", "size", "source_size", "target", "copies")


def _decide(units: DataFrame, per_source: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per unit."""
    of = per_source.withColumnRenamed("source", "_source")
    placed = units.join(of, units["source"].eqNullSafe(of["_source"])).drop("_source").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")),
    ).withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    flown = checkpoint(placed.groupBy("source_rank", "block").applyInPandas(
        lambda key, block: _first_flight(key, block, seed),
        "doc_id long, source string, size long, rows long, source_size long, target double, source_rank long,"
        " block long, place long, whole long, chance double",
    ))
    key, undecided = ["source_rank", "block", "place"], (F.col("chance") > 0) & (F.col("chance") < 1)
    left = flown.filter(undecided).select(*key, (F.col("size") * F.col("rows")).alias("weight"), "chance")
    blocks, level = per_source.agg(F.max("blocks")).first()[0] or 1, 0
    while True:
        level += 1
        span = FAN_IN ** level
        last = blocks <= span
        left = checkpoint(left.groupBy("source_rank", F.floor(F.col("block") / span).alias("joint")).applyInPandas(
            _next_flights(f"{seed}:{level}", last),
            "source_rank long, block long, place long, weight long, chance double",
        ))
        if last:
            break
    settled = left.select(*key, F.col("chance").alias("_settled"))
    # what an inner level decided does not fly again, so every unit left over has exactly one row here
    return flown.join(settled, key, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.round(F.coalesce("_settled", "chance")).cast("long")).alias("copies"),
    )


def _first_flight(key: tuple, block: pd.DataFrame, seed: str) -> pd.DataFrame:
    """Fly one block, largest documents first, so that what stays undecided is small."""
    weight = block["size"] * block["rows"]
    block = block.assign(_w=weight).sort_values(["_w", "doc_id", "size"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    whole = np.floor(block["ratio"] + EPSILON)
    chance = np.clip(block["ratio"] - whole, 0, 1)
    out = block.assign(
        place=np.arange(len(block)), whole=whole.astype("int64"),
        chance=fly(block["_w"].to_numpy(), chance.to_numpy(), f"{seed}:0:{key}"),
    )
    return out[["doc_id", "source", "size", "rows", "source_size", "target", "source_rank", "block", "place", "whole", "chance"]]


def _next_flights(seed: str, last: bool):
    def next_flight(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "block", "place"], ascending=[False, True, True]).reset_index(drop=True)
        size = rows["weight"].to_numpy()
        chance = fly(size, rows["chance"].to_numpy(), f"{seed}:{key}")
        return rows.assign(chance=land(size, chance) if last else chance)[
            ["source_rank", "block", "place", "weight", "chance"]
        ]
    return next_flight

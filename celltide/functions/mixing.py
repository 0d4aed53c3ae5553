"""A small whole-number hash that numpy and SQL compute alike, and keyed shuffles built on it.

All values stay below 2^31, so that products fit a 64-bit integer in every engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

BITS = 31
MASK = (1 << BITS) - 1
FACTOR = 73_244_475
ROUNDS = 10


def mix_values(x: np.ndarray | int) -> np.ndarray | int:
    """Hash of whole numbers in [0, 2^31) to ones in the same range; a plain number or numpy integers."""
    for shift in (16, 15):
        x = ((x ^ (x >> shift)) * FACTOR) & MASK
    return x ^ (x >> 16)


def mix_sql(x: str) -> str:
    """The same hash as SQL text; ``x`` is a column's name."""
    for shift in (16, 15):
        x = f"((xor({x}, {x} >> {shift}) * {FACTOR}) & {MASK})"
    return f"xor({x}, {x} >> 16)"


def draw_values(seed: int, replicate: int, n: int) -> np.ndarray:
    """The rows that one replicate draws: n numbers in [0, n), n below 2^31."""
    key = mix_values(mix_values(seed & MASK) ^ replicate)
    return (mix_values(np.arange(n, dtype=np.int64) ^ key) * n) >> BITS


def _states() -> list[int]:
    out = [1]
    for r in range(ROUNDS):
        out.append(mix_values(out[-1] ^ (r + 7) * 2_654_435))
    return out[1:]


def _steps(n: int) -> list[tuple[int, int, int]]:
    """Per round of a shuffle of n: a factor prime to n, a shift and a number that tells the rounds apart."""
    out = []
    for state in _states():
        factor = state % n
        while math.gcd(factor, n) != 1:
            factor += 1
        out.append((factor % n, mix_values(state) % n, mix_values(state ^ MASK)))
    return out


def shuffled(index: Column, key: Column, n: int) -> Column:
    """The place of each ``index`` in a shuffle of 0..n-1 that ``key`` (in [0, 2^31)) chooses; n is below 2^31.

    Every round is a bijection, so the whole is one for any n: an affine step, and then each number may change places with its
    mirror image about a keyed point, on one bit that both of them see alike. Nothing is sorted or exchanged. The rounds are
    numpy steps over Arrow batches, since as one expression each would repeat the last.
    """

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, of in batches:
            yield pd.Series(shuffle_values(at.to_numpy(), of.to_numpy(dtype=np.int64), n))

    return place(index.cast("long"), key.cast("long"))


def shuffled_sql(source: str, index: str, key: int, name: str) -> str:
    """The same shuffle by one key as SQL text over ``source``, whose columns stay and which counts its own rows."""
    sql = f"SELECT *, {index} AS _at, COUNT(*) OVER () AS _n FROM {source}"
    for state in _states():
        point = mix_values(mix_values(key) ^ mix_values(state ^ MASK))
        factor = f"list_filter(range({state} % _n, {state} % _n + 200), lambda f: gcd(f, _n) = 1)[1] % _n"
        sql = f"SELECT * REPLACE ((_at * ({factor}) + {mix_values(state)} % _n) % _n AS _at) FROM ({sql})"
        sql = f"SELECT *, ({point} % _n - _at + _n) % _n AS _mirror FROM ({sql})"
        sql = f"SELECT *, xor(greatest(_at, _mirror), {point}) AS _seen FROM ({sql})"
        swap = f"{mix_sql('_seen')} & 1 = 1"
        sql = f"SELECT * EXCLUDE (_mirror, _seen) REPLACE (CASE WHEN {swap} THEN _mirror ELSE _at END AS _at) FROM ({sql})"
    return f"SELECT * EXCLUDE (_at, _n), _at AS {name} FROM ({sql})"


def shuffle_values(index: np.ndarray, key: np.ndarray | int, n: int) -> np.ndarray:
    """The same shuffle of numpy integers, all by one key or each by its own."""
    at, key = index.astype(np.int64), mix_values(key)
    for factor, shift, salt in _steps(max(n, 1)):
        at = (at * factor + shift) % n
        point = mix_values(key ^ salt)
        mirror = (point % n - at) % n
        swap = (mix_values(np.maximum(at, mirror) ^ point) & 1) == 1
        at = np.where(swap, mirror, at)
    return at

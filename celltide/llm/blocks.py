"""Small groups of rows, one after the other, in tasks that each hold many of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, list[list]]]:
    """(block, columns) of each block, from batches of rows that are sorted by block."""
    block, held = None, None
    for batch in batches:
        columns = [batch[c].tolist() for c in batch.columns]
        ids = np.asarray(columns[0])
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else [0]
        for a, b in zip(edges, edges[1:]):
            part = [c[a:b] for c in columns[1:]]
            if columns[0][a] == block:
                held = [x + y for x, y in zip(held, part)]
            else:
                if block is not None:
                    yield block, held
                block, held = columns[0][a], part
    if block is not None:
        yield block, held


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")

"""Groups of rows in Python without a call of the engine for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


def together(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Rows with all of a group in one partition, one after the other, in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of a partition made by `together`, whatever batches it is cut into; keys hold whole numbers."""
    rest: list[pd.DataFrame] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        ids = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(int(v) for v in ids[lo])
            if rest and key != last:
                yield last, rest[0] if len(rest) == 1 else pd.concat(rest)
                rest = []
            last = key
            rest.append(b.iloc[lo:hi])
    if rest:
        yield last, rest[0] if len(rest) == 1 else pd.concat(rest)

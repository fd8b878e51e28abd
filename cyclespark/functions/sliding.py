"""Sliding medians of groups of any length.

Places of a group are cut into chunks; a row goes to the chunks in which a window that holds it starts, which is one more
at a chunk's beginning. So a task holds a chunk, never a group. Inside a task the windows of many chunks
slide over one array, in which chunks lie a window apart; the sliding median keeps its window ordered, so a
step costs the logarithm of the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a chunk, or four windows if those are more.
CHUNK = 8192


def sliding_medians(rows: DataFrame, group: list[str], place: str, value: Column, length: int, pad: float | None = None) -> DataFrame:
    """(group, start, median) of each window of ``length`` places of a group, ``start`` from 1 - length on.

    ``place`` numbers the rows of a group from 0 without gaps. Null and NaN values and places outside the group count as ``pad``, or not
    at all where that is None; a window without values has a null median. Even counts take the mean of the middle two.
    """
    size = max(CHUNK, 4 * length)
    at = F.col(place).cast("long")
    chunks = F.sequence(F.floor((at - (length - 1)) / size), F.floor(at / size))
    dealt = rows.select(*group, at.alias("_p"), value.cast("double").alias("_v"), F.explode(chunks).alias("_chunk"))
    keys = [*group, "_chunk"]
    types = dict(dealt.dtypes)

    def medians(b: pd.DataFrame) -> pd.DataFrame:
        """All windows of the whole chunks in ``b``, which is sorted by chunk and place."""
        first = ~b.duplicated(keys).to_numpy()
        begin = np.flatnonzero(first)
        p, v = b["_p"].to_numpy(), b["_v"].to_numpy(float)
        last = np.append(begin[1:], len(b)) - 1
        # from a window before the chunk's first row, or from the chunk's beginning, to its last row; then a window's gap
        low = np.maximum(b["_chunk"].to_numpy()[begin] * size, 1 - length)
        spans = p[last] - low + 1
        base = np.concatenate([[0], np.cumsum(spans + length - 1)])
        flat = np.full(base[-1], np.nan if pad is None else pad)
        of = np.cumsum(first) - 1
        flat[base[of] + p - low[of]] = np.where(np.isnan(v), np.nan if pad is None else pad, v)
        rolled = pd.Series(flat).rolling(length, min_periods=1).median().to_numpy()
        counts = np.minimum(spans, (b["_chunk"].to_numpy()[begin] + 1) * size - low)
        chunk = np.repeat(np.arange(len(begin)), counts)
        step = np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts)
        out = b[group].iloc[begin[chunk]].reset_index(drop=True)
        return out.assign(start=low[chunk] + step, median=rolled[base[chunk] + step + length - 1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            tail = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy() if len(b) else np.zeros(0, bool)
            left = b[tail]  # the last chunk may go on in the next batch
            if not tail.all():
                yield medians(b[~tail])
        if left is not None and len(left):
            yield medians(left)

    schema = ", ".join([*[f"`{g}` {types[g]}" for g in group], "start long, median double"])
    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "_p").mapInPandas(run, schema)
    return found.withColumn("median", F.when(~F.isnan("median"), F.col("median")))

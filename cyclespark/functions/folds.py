"""Folds for steps that depend on their own earlier output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(df: DataFrame, group: list[str], order: list[str], inputs: list[str], name: str, kind: str, begin: Callable[[], object], step: Callable) -> DataFrame:
    """Add column ``name``: the output of ``step(state, *inputs) -> (state, output)`` along each group.

    The rows stream through their task sorted by group and order; only the state is
    kept, so the size of a group does not matter for memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            keys = list(zip(*(b[g] for g in group), strict=True))
            for key, row in zip(keys, zip(*(b[c] for c in inputs), strict=True), strict=True):
                if key != last:
                    last, state = key, begin()
                state, value = step(state, *row)
                out.append(value)
            yield b.assign(**{name: pd.Series(out, b.index, dtype=object if kind not in ("double", "boolean", "int", "long") else None)})

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != name], f"`{name}` {kind}"])
    rows = df.drop(name).repartition(*group).sortWithinPartitions(*group, *order)
    return rows.mapInPandas(run, schema)

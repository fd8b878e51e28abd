"""Sinks (survey group A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cells(cells: DataFrame, path: str) -> None:
    """Nested records as Parquet, partitioned by dataset."""
    cells.write.partitionBy("dataset").parquet(path)


def label_map(labels: DataFrame) -> DataFrame:
    """One JSON map from file name to life for each dataset."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("cell_id", F.lit(".pkl")), "eol"))))
    return labels.groupBy("dataset").agg(F.to_json(entries).alias("value"))


def write_labels(labels: DataFrame, path: str) -> None:
    label_map(labels).write.partitionBy("dataset").text(path)


def write_report(report: DataFrame, order: list[str], path: str) -> None:
    """A report as sorted CSV with a header."""
    report.orderBy(*order).write.option("header", True).csv(path)

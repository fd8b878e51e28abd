"""The windows that operators share, so that successive ones reuse an exchange and a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.sources.shared import scratch

CYCLE = ["cell_id", "cycle_number"]


def in_cycle():
    """Readings of a cycle in record order."""
    return Window.partitionBy(*CYCLE).orderBy("idx")


def whole_cycle():
    return Window.partitionBy(*CYCLE)


def in_cell():
    """Per-cycle rows of a cell in cycle order."""
    return Window.partitionBy("cell_id").orderBy("cycle_number")


def readings_of_cell():
    return Window.partitionBy("cell_id").orderBy("cycle_number", "idx")


def whole_cell():
    return Window.partitionBy("cell_id")


def upwards(keys: list[str], order: list[str]):
    """From the last row of ``keys`` up to this one: ``last(..., ignorenulls)`` over it is the next
    value. A frame that ends at the partition's last row would be walked again for each row."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of each row in ``order``, from 1, without gathering the rows in one task.

    Sorted ranges are written once; a row's place is its place in its range and the sizes of the
    ranges before, of which there are as many as shuffle partitions. Equal rows get places of their own.
    """
    spark = df.sparkSession
    path = scratch(spark, "placed")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_p", F.shiftright("_id", 33))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")
    rows = rows.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")
    return rows.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("int").alias(name))

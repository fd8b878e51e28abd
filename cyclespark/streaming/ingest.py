"""Incremental ingestion: only files that arrived since the last run are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch long, rows long"


def committed(spark: SparkSession, target: str) -> DataFrame:
    """(batch, rows) of the batches that have been written whole; a batch that was written again counts once."""
    path = f"{target}/_manifest"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/*")


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, pipeline: Callable[[DataFrame], DataFrame]) -> int:
    """Run ``pipeline`` over the files of ``source`` that are new, append to ``target``, return the rows read.

    The checkpoint remembers files, so a second call reads none of them again. A batch is read once: its rows are
    counted on their way to the sink. When it has been written, a line of the manifest in ``target`` commits it. A batch that failed
    half-way is written again under its own number, not appended twice; one that is in the manifest already isn't
    written again. Readers who must not see half-written batches take those of ``committed``.
    """
    read = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal read
        if not committed(spark, target).where(F.col("batch") == number).isEmpty():
            return
        seen = Observation()
        pipeline(df.observe(seen, F.count(F.lit(1)).alias("rows"))).write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows = seen.get.get("rows", 0)
        spark.createDataFrame([(number, rows)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{target}/_manifest/{number}")
        read += rows

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read


def read_committed(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows of the committed batches, with their batch."""
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/batch=*").join(committed(spark, target).select("batch"), "batch", "left_semi")

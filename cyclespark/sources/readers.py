"""Readers of raw cycler files (survey group A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclespark.functions.scans import across, in_ranges

READING = "struct<idx:int,t:double,i:double,v:double,qc:double,qd:double,temp:double>"


def read_cycler_csv(spark: SparkSession, path: str, schema: str, pattern: str = r"^(.*?)_timeseries") -> DataFrame:
    """CSV files with a header, one or more a cell; cell_id is the file name up to the marker."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias("cell_id"), "*")


def read_tab_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab logs with a charge counter: cycle_number = count // 2 + 1, mA and mV, date from the file name."""
    rows = spark.read.schema("`Charge count` int, `Time` double, `mA` double, `mV` double").option("header", True).option("sep", "\t").csv(path)
    part = lambda g: F.regexp_extract(F.col("_metadata.file_name"), r"(\d{1,2})_(\d{1,2})_(\d{2})", g).cast("int")
    return rows.select(
        F.format_string("20%02d-%02d-%02d", part(3), part(1), part(2)).alias("date"),
        (F.floor(F.col("Charge count") / 2) + 1).cast("int").alias("cycle_number"),
        F.col("Time").alias("t"), (F.col("mA") / 1000).alias("i"), (F.col("mV") / 1000).alias("v"),
    )


def read_csv_skip_unit_row(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Headed files whose next line holds units: rows that aren't numbers go."""
    rows = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(paths)
    return rows.select(*[F.col(c).try_cast("double").alias(c) for c in columns]).na.drop(how="any")


def read_csv_charset(spark: SparkSession, path: str, charset: str, names: list[str], first: int = 0) -> DataFrame:
    """Localised headers: columns by place, with names of our own.

    GBK needs ``spark.sql.legacy.javaCharsets``, which is set for the session.
    """
    if charset.upper() not in ("UTF-8", "ISO-8859-1", "UTF-16", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.option("header", True).option("encoding", charset).csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns[first : first + len(names)], names, strict=True)])


def read_nested_json(spark: SparkSession, path: str, fields: dict[str, str], root: str = "cycles_interpolated", multi_line: bool = True) -> DataFrame:
    """Column arrays below ``root`` to rows, with idx from 1.

    A file is one document, or with ``multi_line`` off has one a line.
    """
    inner = ", ".join(f"{c}: array<{t}>" for c, t in fields.items())
    rows = spark.read.option("multiLine", multi_line).schema(f"{root} struct<{inner}>").json(path)
    zipped = F.arrays_zip(*[F.col(f"{root}.{c}").alias(c) for c in fields])
    return rows.select(F.col("_metadata.file_name").alias("file"), F.posexplode(zipped).alias("p", "x")).select("file", (F.col("p") + 1).alias("idx"), "x.*")


def decode_phase_json(df: DataFrame, column: str) -> DataFrame:
    """JSON inside a JSON string: per-cycle arrays of the charge, then of the discharge phase.

    The capacity of the other phase is 0. Keeps the other columns.
    """
    half = "struct<I: array<array<double>>, V: array<array<double>>, Q: array<array<double>>, t: array<array<double>>>"
    keep = [c for c in df.columns if c != column]
    doc = df.select(*keep, F.from_json(column, f"QV_charge {half}, QV_discharge {half}").alias("d"))
    parts = []
    for order, (name, phase) in enumerate((("QV_charge", "charge"), ("QV_discharge", "discharge"))):
        cycles = doc.select(*keep, F.posexplode(F.arrays_zip(*[F.col(f"d.{name}.{c}").alias(c) for c in "IVQt"])).alias("c", "x"))
        points = cycles.select(*keep, (F.col("c") + 1).alias("cycle_number"), F.posexplode(F.arrays_zip(*[F.col(f"x.{c}").alias(c) for c in "IVQt"])).alias("p", "y"))
        q = {"charge": (F.col("y.Q"), F.lit(0.0)), "discharge": (F.lit(0.0), F.col("y.Q"))}[phase]
        parts.append(
            points.select(*keep, "cycle_number", F.lit(order).alias("part"), "p", F.col("y.t").alias("t"), F.col("y.I").alias("i"), F.col("y.V").alias("v"), q[0].alias("qc"), q[1].alias("qd"))
        )
    return parts[0].unionByName(parts[1])


def read_parquet_projected(spark: SparkSession, path: str, required: list[str], wanted: list[str]) -> DataFrame | None:
    """The wanted columns that exist; None where a required one is missing."""
    rows = spark.read.parquet(path)
    if not set(required) <= set(rows.columns):
        return None
    return rows.select(*[c for c in wanted if c in rows.columns])


def explode_cells(cells: DataFrame) -> DataFrame:
    """Nested cells (cell_id, cycles array<struct<..., points>>) to readings; the cycle number is the place."""
    cycles = cells.select("cell_id", F.posexplode("cycles").alias("c", "cycle"))
    points = cycles.select("cell_id", (F.col("c") + 1).alias("cycle_number"), F.posexplode("cycle.points").alias("p", "x"))
    return points.select("cell_id", "cycle_number", (F.col("p") + 1).alias("idx"), *[F.col(f"x.{c}").alias(c) for c in ("t", "i", "v", "qc", "qd", "temp")])


POINT = ("idx", "t", "i", "v", "qc", "qd", "temp")


def chunked(rows: DataFrame, order: list[str], point: list[str], size: int = 10_000) -> DataFrame:
    """``rows`` as arrays of at most ``size`` points: cell_id, chunk (from 0), first (the place of its first point, from 0), points.

    ``order`` begins with cell_id. Places run along the whole cell, so the rows of a cell of any length are bounded, and
    an array's place and ``first`` give a point's place back. Rows come from sorted ranges; no task holds a cell.
    """
    placed = across(in_ranges(rows.withColumn("_one", F.lit(1)), order), ["cell_id"], totals={"_place": "_one"}, spent=True)
    points = F.array_sort(F.collect_list(F.struct((F.col("_place") - 1).alias("place"), *point)))
    chunks = placed.groupBy("cell_id", F.floor((F.col("_place") - 1) / size).cast("int").alias("chunk")).agg(points.alias("points"))
    slim = F.transform("points", lambda x: F.struct(*[x[c].alias(c) for c in point]))
    return chunks.select("cell_id", "chunk", F.col("points")[0]["place"].alias("first"), slim.alias("points"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """The rows of ``chunked``: cell_id, place and the points' columns."""
    rows = chunks.select("cell_id", "first", F.posexplode("points").alias("p", "x"))
    return rows.select("cell_id", (F.col("first") + F.col("p")).alias("place"), "x.*")


def nest_readings(readings: DataFrame, size: int = 10_000) -> DataFrame:
    """Readings to records of bounded size: a cell has as many chunks as its points ask for, cycles and points in order."""
    return chunked(readings, ["cell_id", "cycle_number", "idx"], ["cycle_number", *POINT], size)


def unnest_readings(chunks: DataFrame) -> DataFrame:
    """The readings of ``nest_readings``."""
    return from_chunks(chunks).drop("place")


def nested_cells(readings: DataFrame) -> DataFrame:
    """One record a cell, cycles and points in order, for exchange with what expects whole cells; a row grows with its cell."""
    cycles = readings.groupBy("cell_id", "cycle_number").agg(F.array_sort(F.collect_list(F.struct(*POINT))).alias("points"))
    return cycles.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("cycle_number", "points"))).alias("cycles"))


def resume_ingest(candidates: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that aren't done yet, and the counts of both."""
    known = done.select("cell_id").distinct().withColumn("_done", F.lit(True))
    marked = candidates.join(known, "cell_id", "left")
    counts = marked.agg(F.count_if(F.col("_done").isNull()).alias("processed"), F.count_if("_done").alias("skipped"))
    return candidates.join(known, "cell_id", "left_anti"), counts


def read_label_maps(spark: SparkSession, path: str, skip: str = r"^Stanford_labels") -> DataFrame:
    """JSON maps from file name to life as (source, file, eol); files whose name matches ``skip`` are left out."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("source"), "value")
    return rows.where(~F.col("source").rlike(skip)).select("source", F.explode(F.from_json("value", "map<string,double>")).alias("file", "eol")).withColumn("eol", F.col("eol").cast("int"))


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """Union of sheets with unlike columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

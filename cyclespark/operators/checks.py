"""Data-quality checks (survey group I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.scans import across, in_ranges
from cyclespark.functions.windows import CYCLE
from cyclespark.sources.readers import chunked


def monotonicity_violations(values: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Rows (cell_id, cycle_number, phase, idx, value) after which the value falls by more than tol."""
    w = Window.partitionBy(*CYCLE, "phase").orderBy("idx")
    rows = values.withColumns({"next_idx": F.lead("idx").over(w), "diff": F.lead("value").over(w) - F.col("value")})
    return rows.where(F.col("diff") < -tol)


def violation_continuity(violations: DataFrame) -> DataFrame:
    """Per cycle and phase: count, worst fall, and whether the first one is between adjacent records."""
    first = F.min_by(F.col("next_idx") - F.col("idx"), "idx")
    return violations.groupBy("dataset", *CYCLE, "phase").agg(F.count(F.lit(1)).alias("count"), F.min("diff").alias("worst"), (first == 1).alias("continuous"))


def _rates(df: DataFrame) -> DataFrame:
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 4), F.lit(0.0))
    return df.withColumns({"cell_rate": rate("bad_cells", "cells"), "cycle_rate": rate("bad_cycles", "cycles")})


def violation_summary(marks: DataFrame, cycles: DataFrame) -> DataFrame:
    """Per dataset: cells and cycles, those with violations, rates in %, worst fall; clean ones show 0."""
    all_ = cycles.groupBy("dataset").agg(F.count_distinct("cell_id").alias("cells"), F.count(F.lit(1)).alias("cycles"))
    bad = marks.groupBy("dataset").agg(F.count_distinct("cell_id").alias("bad_cells"), F.count_distinct(*CYCLE).alias("bad_cycles"), F.min("worst").alias("worst"))
    return _rates(all_.join(bad, "dataset", "left").na.fill(0, ["bad_cells", "bad_cycles"]).na.fill(0.0, ["worst"]))


def violation_cell_stats(marks: DataFrame, cycles: DataFrame) -> DataFrame:
    """The same per cell."""
    all_ = cycles.groupBy("dataset", "cell_id").agg(F.count(F.lit(1)).alias("cycles"))
    bad = marks.groupBy("dataset", "cell_id").agg(F.count_distinct("cycle_number").alias("bad_cycles"), F.min("worst").alias("worst"))
    out = all_.join(bad, ["dataset", "cell_id"], "left").na.fill(0, ["bad_cycles"]).na.fill(0.0, ["worst"])
    return out.withColumn("cycle_rate", F.round(F.try_divide(100.0 * F.col("bad_cycles"), F.col("cycles")), 4))


def violation_detail(violations: DataFrame) -> DataFrame:
    """Flat rows in order, the fall to ten places."""
    return violations.select("dataset", *CYCLE, "phase", "idx", F.round("diff", 10).alias("diff")).orderBy("dataset", *CYCLE, "phase", "idx")


def violation_index(marks: DataFrame) -> DataFrame:
    """dataset, cell, and its cycles with a map from phase to count and worst fall."""
    entry = F.struct("phase", F.struct("count", "worst"))
    per_cycle = marks.groupBy("dataset", *CYCLE).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("phases"))
    rows = F.collect_list(F.struct("cycle_number", "phases"))
    ordered = F.array_sort(rows, lambda a, b: a["cycle_number"].cast("int") - b["cycle_number"].cast("int"))  # maps have no order
    return per_cycle.groupBy("dataset", "cell_id").agg(ordered.alias("cycles"))


def violation_report(marks: DataFrame, cycles: DataFrame, early: int = 100) -> DataFrame:
    """Per dataset and in total: cycles and cells with violations, early ones, continuous or not, rate."""
    bad = marks.rollup("dataset").agg(
        F.count_distinct(*CYCLE).alias("bad_cycles"), F.count_distinct("cell_id").alias("bad_cells"),
        F.count_if(F.col("cycle_number") <= early).alias("early"), F.count_if("continuous").alias("continuous"), F.count_if(~F.col("continuous")).alias("discontinuous"),
    )
    all_ = cycles.rollup("dataset").agg(F.count(F.lit(1)).alias("cycles"))
    named = lambda d: d.withColumn("dataset", F.coalesce("dataset", F.lit("TOTAL")))
    out = named(all_).join(named(bad), "dataset", "left").na.fill(0)
    return out.withColumn("rate", F.round(100.0 * F.col("bad_cycles") / F.col("cycles"), 4))


def pick_examples(marks: DataFrame, group: str, k: int = 2, seed: int = 0) -> DataFrame:
    """k rows of each group, the same for the same seed."""
    w = Window.partitionBy(group).orderBy(F.xxhash64("cell_id", "cycle_number", F.lit(seed)), "cell_id", "cycle_number")
    return marks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def compare_before_after(before: DataFrame, after: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per cell: lengths, exact and close equality, largest v and i errors by place; missing partners show."""
    def placed(df: DataFrame, p: str) -> DataFrame:
        rows = df.select("cell_id", "cycle_number", "idx", F.col("v").alias(f"v_{p}"), F.col("i").alias(f"i_{p}"), F.lit(1).alias("_one"))
        ranged = across(in_ranges(rows, ["cell_id", "cycle_number", "idx"]), ["cell_id"], totals={"n": "_one"}, spent=True)
        return ranged.select("cell_id", "n", f"v_{p}", f"i_{p}")

    both = placed(before, "a").join(placed(after, "b"), ["cell_id", "n"], "full")
    dv, di = F.abs(F.col("v_a") - F.col("v_b")), F.abs(F.col("i_a") - F.col("i_b"))
    exact = (F.max(dv) == 0) & (F.max(di) == 0)
    return both.groupBy("cell_id").agg(
        F.count("v_a").alias("n_before"), F.count("v_b").alias("n_after"), F.max(dv).alias("max_dv"), F.max(di).alias("max_di"),
        F.coalesce(exact, F.lit(False)).alias("equal"), F.coalesce((F.max(dv) <= tol) & (F.max(di) <= tol), F.lit(False)).alias("close"),
        ((F.count("v_a") == 0) | (F.count("v_b") == 0)).alias("missing"),
    )


def flatten_for_inspection(readings: DataFrame, first_n: int, size: int = 10_000) -> DataFrame:
    """Concatenated series of a cell's first cycles, each as long as the one with most missing values has others.

    Arrays of at most ``size`` points: cell_id, n (points of the cell), chunk, first (place of the first, from 0), v, i, qd, t.
    """
    rows = readings.where(F.col("cycle_number") <= first_n).select("cell_id", "cycle_number", "idx", "v", "i", "qd", "t")
    n = rows.groupBy("cell_id").agg(F.least(F.count("v"), F.count("i"), F.count("qd")).alias("n"))
    ranged = across(in_ranges(rows.withColumn("_one", F.lit(1)), ["cell_id", "cycle_number", "idx"]), ["cell_id"], totals={"_place": "_one"}, constants=n, spent=True)
    kept = ranged.where(F.col("_place") <= F.col("n"))
    chunks = chunked(kept, ["cell_id", "cycle_number", "idx"], ["n", "v", "i", "qd", "t"], size)
    return chunks.select("cell_id", F.get("points.n", 0).alias("n"), "chunk", "first", *[F.col(f"points.{c}").alias(c) for c in ("v", "i", "qd", "t")])

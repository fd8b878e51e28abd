"""Cycle aggregates, state of health and life labels (survey group F).

A label that no integer can hold, as of a line that is flat up to rounding, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.windows import CYCLE, in_cell, upwards, whole_cell
from cyclespark.sources.readers import chunked


def cycle_summary(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*CYCLE).agg(
        F.max("qd").alias("qd_max"), F.max("qc").alias("qc_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.avg("i").alias("i_mean"), F.count(F.lit(1)).alias("n_points"), (F.max("t") - F.min("t")).alias("duration"),
    )


def soh(readings: DataFrame, nominal: Column, span: Column, variant: str = "max") -> DataFrame:
    """State of health per cycle. ``discharge``: over I < 0 rows if there are any; ``signed``: size of their minimum."""
    low = F.col("i") < 0
    top = F.max("qd")
    if variant == "discharge":
        top = F.coalesce(F.max(F.when(low, F.col("qd"))), top)
    elif variant == "signed":
        top = F.abs(F.min(F.when(low, F.col("qd"))))
    return readings.groupBy(*CYCLE).agg((top / F.first(nominal) / F.first(span)).alias("soh"))


def _tail_fit(health: DataFrame, k: int, at: float) -> DataFrame:
    """Cycle number on soh by least squares over the last k cycles, at ``at``, cut to an integer."""
    w = Window.partitionBy("cell_id").orderBy(F.desc("cycle_number"))
    tail = health.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    fit = tail.groupBy("cell_id").agg(F.regr_slope("cycle_number", "soh").alias("b"), F.regr_intercept("cycle_number", "soh").alias("a"))
    return fit.select("cell_id", (F.col("a") + F.col("b") * at).alias("line"))


def life_label(health: DataFrame, end: float = 0.8, near: float = 0.825, k: int = 20) -> DataFrame:
    """eol per cell: first position at or below ``end``; just above it extrapolated; at ``near`` or more null."""
    placed = health.withColumn("position", F.row_number().over(in_cell()))
    cells = placed.groupBy("cell_id").agg(F.max_by("soh", "cycle_number").alias("last_soh"), F.min(F.when(F.col("soh") <= end, F.col("position"))).alias("first"))
    out = cells.join(_tail_fit(health, k, end), "cell_id", "left")
    eol = F.when(F.col("last_soh") >= near, None).when(F.col("last_soh") > end, F.col("line").try_cast("int")).otherwise(F.col("first"))
    return out.select("cell_id", "last_soh", eol.try_cast("int").alias("eol"))


def extrapolate_life(health: DataFrame, k: int = 20, at: float = 0.8) -> DataFrame:
    return _tail_fit(health, k, at).select("cell_id", F.col("line").try_cast("int").alias("eol"))


def life_label_first_cycle_nominal(caps: DataFrame, rules: DataFrame, end: float = 0.9, near: float = 0.925, k: int = 20) -> DataFrame:
    """eol with the first cycle's qd_max as nominal.

    A missing qd_max takes the next one; cycles after the last known one don't count. ``rules``:
    cell_id, skip (position left out) and, if the column is there, early: the line goes through the
    k cycles that end at the first at or below ``near``, for cells whose capacity rises at the end.
    """
    filled = F.last("qd_max", ignorenulls=True).over(upwards(["cell_id"], ["cycle_number"]))
    h = caps.withColumn("qd_max", filled).where("qd_max is not null")
    h = h.withColumn("soh", F.col("qd_max") / F.first("qd_max").over(in_cell())).withColumn("position", F.row_number().over(in_cell()))
    h = h.join(rules, "cell_id", "left").where(F.col("skip").isNull() | (F.col("position") != F.col("skip")))
    cells = h.groupBy("cell_id").agg(F.min("soh").alias("low"), F.min(F.when(F.col("soh") <= end, F.col("position"))).alias("first"))
    tail = h
    if "early" in rules.columns:
        bend = F.min(F.when(F.col("early") & (F.col("soh") <= near), F.col("position"))).over(whole_cell())
        tail = h.withColumn("_bend", bend).where(F.col("_bend").isNull() | (F.col("position") <= F.col("_bend"))).drop("_bend")
    out = cells.join(_tail_fit(tail, k, end), "cell_id", "left")
    eol = F.when(F.col("low") <= end, F.col("first")).when(F.col("low") < near, F.col("line").try_cast("int"))
    return out.select("cell_id", "low", eol.try_cast("int").alias("eol"))


def _crossings(health: DataFrame, tau: float) -> DataFrame:
    w = in_cell()
    rows = health.withColumns({"x0": F.lag("cycle_number").over(w), "y0": F.lag("soh").over(w)})
    d = F.col("soh") - F.col("y0")
    x = F.when(F.abs(d) < 1e-12, F.col("cycle_number").cast("double")).otherwise(F.col("x0") + (tau - F.col("y0")) * (F.col("cycle_number") - F.col("x0")) / d)
    return rows.withColumn("cross", F.when((F.col("y0") > tau) & (F.col("soh") <= tau), x))


def life_last_crossing(health: DataFrame, tau: float = 0.8, near: float = 0.825, k: int = 20) -> DataFrame:
    """The last descending crossing, else the start if below, else the tail's line if close; rounded up."""
    cells = _crossings(health, tau).groupBy("cell_id").agg(
        F.max("cross").alias("cross"), F.min_by("soh", "cycle_number").alias("y_first"), F.min("cycle_number").alias("x_first"), F.max_by("soh", "cycle_number").alias("y_last")
    )
    out = cells.join(_tail_fit(health, k, tau), "cell_id", "left")
    tail = F.when((F.col("y_last") > tau) & (F.col("y_last") < near), F.col("line"))
    eol = F.coalesce("cross", F.when(F.col("y_first") <= tau, F.col("x_first").cast("double")), tail)
    return out.select("cell_id", F.ceil(eol).try_cast("int").alias("eol"))


def life_first_crossing(health: DataFrame, tau: float = 0.8) -> DataFrame:
    """The start if below, else the first descending crossing, else the last two points' line if it meets later; rounded up."""
    w = Window.partitionBy("cell_id").orderBy(F.desc("cycle_number"))
    rows = _crossings(health, tau).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("_n") == 1, F.struct("x0", "y0", F.col("cycle_number").alias("x1"), F.col("soh").alias("y1"))))
    cells = rows.groupBy("cell_id").agg(
        F.min("cross").alias("cross"), F.min_by("soh", "cycle_number").alias("y_first"), F.min("cycle_number").alias("x_first"), last.alias("p")
    )
    p = F.col("p")
    line = p["x0"] + (tau - p["y0"]) * (p["x1"] - p["x0"]) / F.nullif(p["y1"] - p["y0"], F.lit(0.0))
    ahead = F.when(line >= p["x1"], line)
    eol = F.when(F.col("y_first") <= tau, F.col("x_first").cast("double")).otherwise(F.coalesce("cross", ahead))
    return cells.select("cell_id", F.ceil(eol).try_cast("int").alias("eol"))


def efc_curve(throughput: DataFrame, capacity: DataFrame) -> DataFrame:
    """Equivalent full cycles against health; both lists paired by order and cut to the shorter.

    ``throughput``: cell_id, rpt_order, throughput; ``capacity``: cell_id, rpt_order, qd.
    """
    both = throughput.join(capacity, ["cell_id", "rpt_order"])
    w = Window.partitionBy("cell_id").orderBy("rpt_order")
    first_t, first_q = F.first("throughput").over(w), F.first("qd").over(w)
    return both.select("cell_id", "rpt_order", ((F.col("throughput") - first_t) / first_q).alias("efc"), (F.col("qd") / first_q).alias("soh"))


def labels_from_table(cells: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels by the last all-digit token of the name (``table``: cell_index, life), and the cells without."""
    token = F.try_element_at(F.filter(F.split("cell_id", "_"), lambda x: x.rlike(r"^\d+$")), F.lit(-1)).cast("long")
    named = cells.withColumn("cell_index", token)
    found = named.join(table, "cell_index").select("cell_id", F.ceil("life").cast("int").alias("eol"))
    return found, named.join(table, "cell_index", "left_anti")


def initial_soc_window(readings: DataFrame, nominal: float = 0.25) -> DataFrame:
    """Start and end state of charge from the first cycle's capacities."""
    first = readings.where("cycle_number = 1").groupBy("cell_id").agg((F.max("qc") / nominal).alias("c"), (F.max("qd") / nominal).alias("d"))
    start = 1 - F.least(F.col("c"), F.lit(1.0))
    end = 1 - F.when(F.col("d") > 1, 0.0).otherwise(F.col("d"))
    both = first.select("cell_id", start.alias("s"), end.alias("e"))
    full = (F.col("s") == 1) & (F.col("e") == 1)
    return both.select("cell_id", F.when(full, 0.0).otherwise(F.col("s")).alias("soc_start"), F.when(full, 1.0).otherwise(F.col("e")).alias("soc_end"))


def cleaning_stats(counts: DataFrame) -> DataFrame:
    """Totals over cells of raw, removed and replaced cycles, with percentages."""
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("removed").alias("removed"), F.sum("replaced").alias("replaced"))
    share = lambda c: F.try_divide(100.0 * F.col(c), F.col("raw"))
    return total.select("raw", "removed", "replaced", (F.col("raw") - F.col("removed")).alias("final"), share("removed").alias("removed_pct"), share("replaced").alias("replaced_pct"))


def battery_type_histogram(labels: DataFrame, width: int = 100) -> DataFrame:
    """Labels by chemistry and bin."""
    return labels.groupBy("chemistry", (F.floor(F.col("eol") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def soh_trajectories(health: DataFrame, least: float = 0.78, size: int = 10_000) -> DataFrame:
    """Ordered health of each cell whose last one is at least ``least``: chunks of at most ``size`` cycles.

    cell_id, chunk, start (place of the chunk's first cycle, from 0), curve; first and last are the cell's first and last cycle.
    """
    ends = health.groupBy("cell_id").agg(F.min("cycle_number").alias("first"), F.max("cycle_number").alias("last"), F.max_by("soh", "cycle_number").alias("_end"))
    kept = ends.where(F.col("_end") >= least).drop("_end")
    chunks = chunked(health.select("cell_id", "cycle_number", "soh"), ["cell_id", "cycle_number"], ["soh"], size)
    return chunks.join(kept, "cell_id").select("cell_id", "chunk", chunks["first"].alias("start"), F.col("points.soh").alias("curve"), kept["first"], "last")


def cycles_of_cell(cycles: DataFrame) -> DataFrame:
    return cycles.withColumn("n_cycles", F.count(F.lit(1)).over(whole_cell()))

"""Filters, renumbering, outliers and imputation (survey groups B and E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.parse import DATASET_IDS, name_prefix, to_number
from cyclespark.functions.quantiles import group_quantiles
from cyclespark.functions.scans import across, in_ranges
from cyclespark.functions.sliding import sliding_medians
from cyclespark.functions.windows import CYCLE, in_cell, in_cycle, upwards, whole_cell, whole_cycle
from cyclespark.sources.shared import scratch


# --- B: projection, filters, renumbering ---------------------------------------------


def dataset_id(cells: DataFrame, override: DataFrame | None = None, ids: dict[str, int] | None = None) -> DataFrame:
    """Add dataset_id by the name's prefix; cells of ``override`` (cell_id, id) take its id."""
    table = F.create_map(*[F.lit(x) for kv in (ids or DATASET_IDS).items() for x in kv])
    found = cells.withColumn("dataset_id", table[name_prefix(F.col("cell_id"))])
    if override is None:
        return found
    special = override.select("cell_id", F.col("id").alias("_id"))
    return found.join(special, "cell_id", "left").withColumn("dataset_id", F.coalesce("_id", "dataset_id")).drop("_id")


def material_metadata(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Join the constants of each dataset by the name's prefix."""
    return cells.withColumn("prefix", name_prefix(F.col("cell_id"))).join(meta, "prefix", "left")


def convert_units(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Multiply columns by their factors (mA to A, minutes to seconds ...)."""
    return df.withColumns({c: F.col(c) * k for c, k in factors.items()})


def coerce_numeric(df: DataFrame, columns: list[str], required: list[str], dash_is_zero: bool = False) -> DataFrame:
    """Text to finite doubles, else null; rows without a required value go."""
    return df.withColumns({c: to_number(F.col(c), dash_is_zero) for c in columns}).na.drop(subset=required)


def drop_cells(cells: DataFrame, listed: DataFrame, pattern: str | None = None) -> DataFrame:
    """Without the cells of ``listed`` (cell_id) and those whose name matches ``pattern``."""
    left = cells.join(listed.select("cell_id").distinct(), "cell_id", "left_anti")
    return left.where(~F.col("cell_id").rlike(pattern)) if pattern else left


def drop_by_rules(cycles: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cycles that no rule breaks, and the removed numbers by cell.

    A rule is (cell_id, lo, hi, op, threshold): inside lo..hi, cycles go whose qd_max is
    above (op ``>``) or below (op ``<``) the threshold. An equi join on the cell, so the
    range is only tested against the rules of the same cell.
    """
    r = rules.select(F.col("cell_id").alias("_c"), "lo", "hi", "op", "threshold")
    broken = F.when(F.col("op") == ">", F.col("qd_max") > F.col("threshold")).otherwise(F.col("qd_max") < F.col("threshold"))
    on = (F.col("cell_id") == F.col("_c")) & F.col("cycle_number").between(F.col("lo"), F.col("hi")) & broken
    gone = cycles.join(r, on).select(*CYCLE).distinct()
    report = gone.groupBy("cell_id").agg(F.sort_array(F.collect_list("cycle_number")).alias("removed"))
    return cycles.join(gone, CYCLE, "left_anti"), report


def drop_formation(readings: DataFrame, first: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Skip the first n cycles of each dataset and shift the numbers; ``first``: dataset, n.

    ``cells``: prefix, n, shift. Cells whose names begin with a prefix follow its row instead of
    their dataset's; without shift the numbers stay. Of several rows the longest prefix holds.
    """
    rows = readings.join(first.select("dataset", F.col("n").alias("_n")), "dataset", "left").withColumn("_shift", F.lit(True))
    if cells is not None:
        names = readings.select("cell_id").distinct()
        hit = names.join(F.broadcast(cells.select("prefix", "n", "shift")), F.col("cell_id").startswith(F.col("prefix")))
        hit = hit.groupBy("cell_id").agg(F.max_by(F.struct("n", "shift"), F.length("prefix")).alias("_own"))
        rows = rows.join(hit, "cell_id", "left").withColumns({"_n": F.coalesce("_own.n", "_n"), "_shift": F.coalesce("_own.shift", "_shift")})
    n = F.coalesce("_n", F.lit(0))
    moved = (F.col("cycle_number") - F.when(F.col("_shift"), n).otherwise(0)).cast("int")
    return rows.where(F.col("cycle_number") > n).select(*[moved.alias(c) if c == "cycle_number" else c for c in readings.columns])


def renumber_cycles(readings: DataFrame) -> DataFrame:
    """Surviving cycle numbers, 0 excluded, become 1..n in order."""
    w = Window.partitionBy("cell_id").orderBy("cycle_number")
    return readings.where("cycle_number != 0").withColumn("cycle_number", F.dense_rank().over(w))


def unwrap_cycle_index(readings: DataFrame, order: list[str], raw: str = "raw_index") -> DataFrame:
    """Add unwrapped: the first raw index, plus one at each change from row to row."""
    first = readings.groupBy("cell_id").agg(F.min_by(raw, F.struct(*order)).alias("_first"))
    rows = across(in_ranges(readings, ["cell_id", *order]), ["cell_id"], previous={"_before": raw}, constants=first, spent=True)
    rows = rows.withColumn("_step", F.coalesce((F.col(raw) != F.col("_before.v")).cast("int"), F.lit(0)))
    rows = across(rows, ["cell_id"], totals={"_steps": "_step"}, spent=True)
    return rows.select(*readings.columns, (F.col("_first") + F.col("_steps")).alias("unwrapped"))


def dedupe_readings(readings: DataFrame, stamp: str, tie: str) -> DataFrame:
    """The first row by ``tie`` of each (cell, stamp)."""
    w = Window.partitionBy("cell_id", stamp).orderBy(tie)
    return readings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mask_negative_and_bfill(readings: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of negative capacity become null and take the next value of their cycle."""
    bad = (F.col("qc") < 0) | (F.col("qd") < 0)
    after = upwards(CYCLE, ["idx"])
    return readings.withColumns({c: F.last(F.when(~bad, F.col(c)), ignorenulls=True).over(after) for c in columns})


def early_life_prefix(readings: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Cycles up to and including the first beyond min(threshold, eol)."""
    return readings.join(labels, "cell_id").where(F.col("cycle_number") <= F.least(F.lit(threshold), F.col("eol")) + 1)


def zero_inactive_capacity(readings: DataFrame) -> DataFrame:
    """Tiny negative currents go; the capacity of the inactive phase is 0."""
    kept = readings.where(~((F.col("i") > -0.001) & (F.col("i") < 0)))
    return kept.withColumns({"qd": F.when(F.col("i") >= 0, 0.0).otherwise(F.col("qd")), "qc": F.when(F.col("i") < 0, 0.0).otherwise(F.col("qc"))})


def drop_last_cycle(readings: DataFrame) -> DataFrame:
    """Cycles below the number of distinct cycles of the cell."""
    n = readings.groupBy("cell_id").agg(F.count_distinct("cycle_number").alias("_n"))
    return readings.join(n, "cell_id").where("cycle_number < _n").select(*readings.columns)


def drop_short_cycles(readings: DataFrame, least: int = 2) -> DataFrame:
    return readings.withColumn("_n", F.count(F.lit(1)).over(whole_cycle())).where(F.col("_n") >= least).drop("_n")


def keep_cycles_by_capacity_range(readings: DataFrame, low: float, high: float) -> DataFrame:
    """Whole cycles with low < max discharge capacity < high."""
    top = F.max("qd").over(whole_cycle())
    return readings.withColumn("_q", top).where((F.col("_q") > low) & (F.col("_q") < high)).drop("_q")


def keep_cycles_by_first_current(readings: DataFrame, centre: float, tolerance: float) -> DataFrame:
    """Whole cycles whose first current is within ``tolerance`` of ``centre``, ends excluded."""
    first = readings.groupBy(*CYCLE).agg(F.min_by("i", "idx").alias("_i"))
    good = first.where((F.col("_i") > centre - tolerance) & (F.col("_i") < centre + tolerance)).select(*CYCLE)
    return readings.join(good, CYCLE, "left_semi")


def cap_at_problem_cycle(cycles: DataFrame) -> DataFrame:
    """Cycles up to the first of efficiency below 1, else all."""
    end = F.coalesce(F.min(F.when(F.col("efficiency") < 1, F.col("cycle_number"))).over(whole_cell()), F.max("cycle_number").over(whole_cell()))
    return cycles.withColumn("_end", end).where("cycle_number <= _end").drop("_end")


def splice_cells(cycles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Append the cycles of pairs.tail to pairs.head, numbered on from its last, and drop the tail cell."""
    sizes = cycles.groupBy("cell_id").agg(F.max("cycle_number").alias("_shift"))
    named = pairs.join(sizes, pairs["head"] == sizes["cell_id"]).select("head", "tail", "_shift")
    moved = cycles.join(named, F.col("cell_id") == F.col("tail"), "left")
    number = F.col("cycle_number") + F.coalesce("_shift", F.lit(0))
    return moved.withColumns({"cell_id": F.coalesce("head", "cell_id"), "cycle_number": number.cast("int")}).drop("head", "tail", "_shift")


def skip_defect_cycle(cycles: DataFrame, defects: DataFrame) -> DataFrame:
    """Drop cycle ``at`` of each listed cell and move the later ones up by one."""
    d = cycles.join(defects, "cell_id", "left").where(F.col("at").isNull() | (F.col("cycle_number") != F.col("at")))
    return d.withColumn("cycle_number", F.col("cycle_number") - F.coalesce((F.col("cycle_number") > F.col("at")).cast("int"), F.lit(0))).drop("at")


def fill_with_cycle_median(readings: DataFrame, column: str) -> DataFrame:
    """Null or NaN values take the median of the finite ones of their cycle."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    rows = in_ranges(readings, [*CYCLE, "idx"])
    out = across(rows, CYCLE, constants=group_quantiles(rows, CYCLE, value, {"_m": 0.5}), spent=True)
    return out.withColumn(column, F.coalesce(value, "_m")).select(*readings.columns)


def attach_cycle_summary(cycles: DataFrame, summary: DataFrame) -> DataFrame:
    """Join per-cycle scalars by cell and position."""
    return cycles.join(summary, CYCLE, "left")


# --- E: outliers and imputation --------------------------------------------------------


def _by_cell(cycles: DataFrame, columns: dict[str, Column], at: float = 0.5) -> DataFrame:
    """``cycles`` with a quantile over the cell for each of ``columns``, all of them selected in the same rounds.

    ``cycles`` is written first, as it is read several times.
    """
    path = scratch(cycles.sparkSession, "by-cell")
    cycles.write.parquet(path)
    cycles = cycles.sparkSession.read.schema(cycles.schema).parquet(path)
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("_of"), c.cast("double").alias("_x")) for n, c in columns.items()])).alias("_v")
    long = cycles.select("cell_id", values).select("cell_id", "_v.*")
    found = group_quantiles(long, ["cell_id", "_of"], F.col("_x"), {"_q": at})
    wide = found.groupBy("cell_id").agg(*[F.max(F.when(F.col("_of") == n, F.col("_q"))).alias(n) for n in columns])
    return cycles.join(wide, "cell_id")


def _placed_cycles(cycles: DataFrame) -> DataFrame:
    """``cycles`` in ranges, with _place: the place in the cell from 0."""
    rows = across(in_ranges(cycles.withColumn("_one", F.lit(1)), CYCLE), ["cell_id"], totals={"_upto": "_one"}, spent=True)
    return rows.withColumn("_place", F.col("_upto") - 1)


def median_filter_outliers(cycles: DataFrame, k: int = 21) -> DataFrame:
    """Cycles near a zero-padded running median of qd_max over ``k`` (odd) cycles and above 0.1, renumbered."""
    rows = _placed_cycles(cycles)
    middle = sliding_medians(rows, ["cell_id"], "_place", F.col("qd_max"), k, pad=0.0).select("cell_id", (F.col("start") + k // 2).alias("_place"), "median")
    off = rows.join(middle, ["cell_id", "_place"]).withColumn("_off", F.abs(F.col("qd_max") - F.col("median"))).select(*cycles.columns, "_off")
    kept = _by_cell(off, {"_m": F.col("_off")}).where("_off < 3 * _m and qd_max > 0.1").drop("_off", "_m")
    return kept.withColumn("cycle_number", F.row_number().over(in_cell()))


def _shift_distance(s: int) -> Column:
    w, far = in_cell(), F.lit(float("inf"))
    ago = F.coalesce(F.abs(F.col("qd_max") - F.lag("qd_max", s).over(w)), far)
    ahead = F.coalesce(F.abs(F.col("qd_max") - F.lead("qd_max", s).over(w)), far)
    return F.least(ago, ahead)


def shift_outliers(cycles: DataFrame, shifts: int = 2, ths: float = 10) -> DataFrame:
    """Add excluded: far from both neighbours at some shift, against the median distance."""
    out = cycles.withColumns({f"_d{s}": _shift_distance(s) for s in range(1, shifts + 1)})
    near = lambda d: F.when((d > 0) & (d < float("inf")), d)
    out, flag = _by_cell(out, {f"_m{s}": near(F.col(f"_d{s}")) for s in range(1, shifts + 1)}), F.lit(False)
    for s in range(1, shifts + 1):
        flag = flag | F.coalesce(F.col(f"_d{s}") > ths * F.col(f"_m{s}"), F.lit(False))
    return out.withColumn("excluded", flag).drop(*[f"_{x}{s}" for x in "dm" for s in range(1, shifts + 1)])


def hampel_shift_outliers(cycles: DataFrame, shifts: int, ths: float = 3) -> DataFrame:
    """As shift_outliers, by distance from the median in units of the median deviation."""
    out = cycles.withColumns({f"_d{s}": _shift_distance(s) for s in range(1, shifts + 1)})
    each = range(1, shifts + 1)
    out = _by_cell(out, {f"_m{s}": F.col(f"_d{s}") for s in each})
    out = out.withColumns({f"_a{s}": F.abs(F.col(f"_d{s}") - F.col(f"_m{s}")) for s in each})
    out, flag = _by_cell(out, {f"_b{s}": F.col(f"_a{s}") for s in each}), F.lit(False)
    for s in each:
        flag = flag | F.coalesce(F.col(f"_a{s}") > ths * F.col(f"_b{s}"), F.lit(False))
    return out.withColumn("excluded", flag).drop(*[f"_{x}{s}" for x in "dmab" for s in each])


def two_sided_median_outliers(cycles: DataFrame, eps: float = 0.05, w: int = 5) -> DataFrame:
    """Drop cycles far from the median of the w before and of themselves with the w-1 after."""
    rows = _placed_cycles(cycles)
    middle = sliding_medians(rows, ["cell_id"], "_place", F.col("qd_max"), w)
    before = middle.select("cell_id", (F.col("start") + w).alias("_place"), F.col("median").alias("_b"))
    after = middle.select("cell_id", F.col("start").alias("_place"), F.col("median").alias("_a"))
    size = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_last"))
    out = rows.join(before, ["cell_id", "_place"], "left").join(after, ["cell_id", "_place"], "left").join(size, "cell_id")
    far = (F.abs(F.col("qd_max") - F.col("_b")) > eps) & (F.abs(F.col("qd_max") - F.col("_a")) > eps)
    inner = (F.col("_place") >= w) & (F.col("_place") < F.col("_last") - w)
    return out.where(~(inner & far)).select(*cycles.columns)


def missing_cycles(cycles: DataFrame) -> DataFrame:
    """Numbers from 1 to the cell's largest that are absent."""
    all_ = cycles.groupBy("cell_id").agg(F.max("cycle_number").alias("n")).select("cell_id", F.explode(F.sequence(F.lit(1), "n")).alias("cycle_number"))
    return all_.join(cycles.select(*CYCLE), CYCLE, "left_anti")


def _nearest_good(cycles: DataFrame) -> DataFrame:
    """For each number of ``cycles`` (cell_id, cycle_number, good): the good ones before and after."""
    w = in_cell()
    good = F.when(F.col("good"), F.col("cycle_number"))
    before = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(good, ignorenulls=True).over(upwards(["cell_id"], ["cycle_number"]))
    return cycles.withColumns({"_before": before, "_after": after})


def impute_bad_cycles(readings: DataFrame, bad: DataFrame) -> DataFrame:
    """Each bad or missing cycle gets a full copy of the nearest earlier good one, else the next."""
    present = readings.select(*CYCLE).distinct()
    listed = bad.select(*CYCLE).distinct().withColumn("_bad", F.lit(True))
    marked = present.withColumn("_here", F.lit(True)).join(listed, CYCLE, "full").withColumn("good", F.col("_here").isNotNull() & F.col("_bad").isNull())
    source = _nearest_good(marked.select(*CYCLE, "good")).select("cell_id", F.col("cycle_number").alias("_to"), F.coalesce("_before", "_after").alias("cycle_number"))
    return readings.join(source, CYCLE).withColumn("cycle_number", F.col("_to")).drop("_to")


def replace_diagnostic_cycles(readings: DataFrame, target: float = -0.48, tolerance: float = 0.03, exempt: list[str] | None = None) -> DataFrame:
    """Cycles whose mean discharge current is near ``target`` get the rows of the nearest other one.

    The earlier one wins on equal distance. Adds replaced.
    """
    mean = readings.groupBy(*CYCLE).agg(F.avg(F.when(F.col("i") < 0, F.col("i"))).alias("_i"))
    odd = F.coalesce(F.abs(F.col("_i") - target) <= tolerance, F.lit(False)) & ~F.col("cell_id").isin(exempt or [])
    near = _nearest_good(mean.withColumn("good", ~odd))
    number, b, a = F.col("cycle_number"), F.col("_before"), F.col("_after")
    pick = F.when(b.isNull(), a).when(a.isNull(), b).when(number - b <= a - number, b).otherwise(a)
    source = near.select("cell_id", number.alias("_to"), F.coalesce(pick, number).alias("cycle_number"))
    return readings.join(source, CYCLE).withColumn("replaced", F.col("_to") != F.col("cycle_number")).withColumn("cycle_number", F.col("_to")).drop("_to")


def drop_half_cycles(cycles: DataFrame, limit: float = 1.2 * 0.6 * 3.2) -> DataFrame:
    """In cells named 20-80, cycles of more capacity than a half cycle allows go."""
    return cycles.where(~(F.col("cell_id").contains("20-80") & (F.col("qd_max") > limit)))

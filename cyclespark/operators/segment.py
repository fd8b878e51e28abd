"""Integration and segmentation (survey group D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.folds import sorted_fold
from cyclespark.functions.quantiles import group_quantiles
from cyclespark.functions.scans import across, in_ranges
from cyclespark.functions.windows import CYCLE, in_cell, in_cycle, whole_cycle
from cyclespark.sources.shared import scratch

ACTIVE = 0.01
READING = ["cell_id", "cycle_number", "idx"]


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def coulomb_count(readings: DataFrame, scale: float = 3600) -> DataFrame:
    """qc and qd by the rightward rectangle rule, from 0 in each cycle."""
    dt = F.col("t") - F.lag("t").over(in_cycle())
    part = F.coalesce(F.col("i") * dt / scale, F.lit(0.0))
    out = readings.withColumns({"_c": F.when(F.col("i") > 0, part).otherwise(0.0), "_d": F.when(F.col("i") < 0, -part).otherwise(0.0)})
    return out.withColumns({"qc": F.sum("_c").over(_running(in_cycle())), "qd": F.sum("_d").over(_running(in_cycle()))}).drop("_c", "_d")


def coulomb_count_capped(readings: DataFrame, cap: float = 2, scale: float = 3600) -> DataFrame:
    """As coulomb_count, but a value that would reach ``cap`` leaves 0 and starts anew."""

    def step(state, i, t):
        if state is None:
            return (t, 0.0, 0.0), {"qc": 0.0, "qd": 0.0}
        t0, c, d = state
        c2 = c + i * (t - t0) / scale if i > 0 else c
        d2 = d - i * (t - t0) / scale if i < 0 else d
        c2, d2 = (c2 if c2 < cap else 0.0), (d2 if d2 < cap else 0.0)
        return (t, c2, d2), {"qc": c2, "qd": d2}

    out = sorted_fold(readings, CYCLE, ["idx"], ["i", "t"], "_q", "struct<qc:double,qd:double>", lambda: None, step)
    return out.withColumns({"qc": F.col("_q.qc"), "qd": F.col("_q.qd")}).drop("_q")


def trapezoid_by_run(readings: DataFrame, scale: float = 3600) -> DataFrame:
    """q_run: trapezoid sum inside each run of one current sign; the run starts from zero current."""
    sign = F.signum("i")
    change = F.coalesce((sign != F.lag(sign).over(in_cycle())).cast("int"), F.lit(1))
    out = readings.withColumn("_dt", F.greatest(F.coalesce(F.col("t") - F.lag("t").over(in_cycle()), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("_new", change).withColumn("run", F.sum("_new").over(_running(in_cycle())))
    w = Window.partitionBy(*CYCLE, "run").orderBy("idx")
    part = 0.5 * (F.coalesce(F.lag(F.abs("i")).over(w), F.lit(0.0)) + F.abs("i")) * F.col("_dt") / scale
    out = out.withColumn("_part", F.when(F.col("i") == 0, 0.0).otherwise(part))
    return out.withColumn("q_run", F.sum("_part").over(_running(w))).drop("_dt", "_new", "_part")


def split_capacity_column(readings: DataFrame, nominal: float, column: str = "cap", strict: bool = False) -> DataFrame:
    """qc and qd from one capacity column, each zeroed inside the other phase and at rest."""
    c = F.col("i") / nominal
    charge = c > ACTIVE if strict else c >= ACTIVE
    discharge = c < -ACTIVE if strict else c <= -ACTIVE
    w = whole_cycle()
    ends = {f"_{n}{k}": f(F.when(m, F.col("idx"))).over(w) for n, m in (("c", charge), ("d", discharge)) for k, f in (("0", F.min), ("1", F.max))}
    rest = ~charge & ~discharge
    inside = lambda n: F.coalesce(F.col("idx").between(F.col(f"_{n}0"), F.col(f"_{n}1")), F.lit(False))
    return readings.withColumns(ends).withColumns(
        {"qd": F.when(inside("c") | rest, 0.0).otherwise(F.col(column)), "qc": F.when(inside("d") | rest, 0.0).otherwise(F.col(column))}
    ).drop(*ends)


def accumulate_step_capacity(readings: DataFrame, raw: str = "raw", step: str = "step") -> DataFrame:
    """qc: raw capacity of steps with charge rows, carried on from step to step; other rows 0."""
    charge = F.col("kind") == "charge"
    steps = readings.groupBy(*CYCLE, step).agg(F.min("idx").alias("_at"), F.max_by(raw, "idx").alias("_last"), F.max(charge).alias("_charges"))
    steps = steps.where("_charges")
    carry = F.coalesce(F.sum("_last").over(Window.partitionBy(*CYCLE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = steps.withColumn("_carry", carry).select(*CYCLE, step, "_carry")
    out = readings.join(carried, [*CYCLE, step], "left")
    return out.withColumns(
        {"qc": F.coalesce(F.col(raw) + F.col("_carry"), F.lit(0.0)), "qd": F.when(F.col("kind") == "discharge", F.col("raw_qd")).otherwise(0.0)}
    ).drop("_carry")


def charge_from_total(readings: DataFrame) -> DataFrame:
    return readings.withColumn("qc", F.col("total") - F.col("qd"))


def stage_of(c_rate: Column, threshold: float = 0.02) -> Column:
    return F.when(F.abs(c_rate) <= threshold, "rest").when(c_rate > 0, "charge").otherwise("discharge")


def classify_stage(readings: DataFrame, nominal: float, threshold: float = 0.02) -> DataFrame:
    return readings.withColumn("stage", stage_of(F.col("i") / nominal, threshold))


def compress_stages(staged: DataFrame) -> DataFrame:
    """Per cycle the stages in order without equal neighbours; odd: several charge or discharge ones."""
    new = F.coalesce(F.col("stage") != F.lag("stage").over(in_cycle()), F.lit(True))
    kept = staged.withColumn("_new", new).where("_new")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "stage"))), lambda x: x["stage"])
    many = lambda k: F.size(F.filter("stages", lambda x: x == k)) > 1
    return kept.groupBy(*CYCLE).agg(listed.alias("stages")).withColumn("odd", many("charge") | many("discharge"))


def find_cycle_ends(readings: DataFrame, lag: int = 10, tolerance: float = 0.1, quiet: int = 250) -> DataFrame:
    """Add cycle_end: the first of ``lag`` discharge rows in a row, unless one lies ``quiet`` rows before.

    ``readings`` has n, the row's place in the cell from 0. Which candidates count follows from the one that counted
    before; that chain is followed in doubling steps.
    """
    i, before, after = F.col("i"), F.col("_before.v"), F.col("_after.v")
    rows = across(in_ranges(readings, ["cell_id", "n"]), ["cell_id"], previous={"_before": "i"}, following={"_after": "i"}, spent=True)
    spike = (F.abs(i - before) > tolerance) & (F.abs(i - after) > tolerance)
    smooth = rows.withColumn("_i", F.when(F.coalesce(spike, F.lit(False)), after).otherwise(i))
    smooth = across(smooth.withColumn("_stop", F.when(F.col("_i") >= 0, F.col("n"))), ["cell_id"], known={"_stopped": "_stop"}, spent=True)
    run = F.col("n") - F.coalesce(F.col("_stopped"), F.lit(-1))
    found = smooth.where((F.col("_i") < 0) & (run == lag)).select("cell_id", (F.col("n") - lag + 1).alias("n"))
    marks = _chained(found, quiet).withColumn("cycle_end", F.lit(True))
    return readings.join(marks, ["cell_id", "n"], "left").withColumn("cycle_end", F.coalesce("cycle_end", F.lit(False)))


def _chained(candidates: DataFrame, quiet: int) -> DataFrame:
    """Those of ``candidates`` (cell_id, n) that are the first of their cell, follow a kept one by over ``quiet``, or aren't past ``quiet``.

    Each candidate points to the one that would be kept next. What the first reaches is found by doubling: in each
    round kept ones pass on to what they point to, and pointers are followed twice as far.
    """
    spark, path = candidates.sparkSession, scratch(candidates.sparkSession, "chain")
    kind = dict(candidates.dtypes)["n"]
    # the first candidate past the quiet span: candidates and ends of spans in one falling order
    asked = candidates.select("cell_id", (F.col("n") + quiet + 1).alias("at"), F.col("n").alias("of"), F.lit(None).cast(kind).alias("n"))
    both = candidates.select("cell_id", F.col("n").alias("at"), F.lit(None).cast(kind).alias("of"), "n").unionByName(asked)
    falling = Window.partitionBy("cell_id").orderBy(F.desc("at"), F.col("n").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    past = both.withColumn("past", F.last("n", ignorenulls=True).over(falling)).where("of is not null").select("cell_id", F.col("of").alias("n"), "past")
    w = Window.partitionBy("cell_id").orderBy("n")
    near = past.withColumn("near", F.lead("n").over(w)).withColumn("kept", F.row_number().over(w) == 1)
    jump = F.when(F.col("near") <= quiet, F.col("near")).otherwise(F.col("past"))
    near.select("cell_id", "n", "kept", jump.alias("to")).write.parquet(f"{path}/0")
    now, number = spark.read.parquet(f"{path}/0"), 0
    while not now.where("kept and to is not null").isEmpty():
        number += 1
        reached = now.where("kept and to is not null").select("cell_id", F.col("to").alias("n"), F.lit(True).alias("_reached")).distinct()
        far = now.select("cell_id", F.col("n").alias("to"), F.col("to").alias("_far"))
        step = now.join(reached, ["cell_id", "n"], "left").join(far, ["cell_id", "to"], "left")
        step.select("cell_id", "n", (F.col("kept") | F.col("_reached").isNotNull()).alias("kept"), F.col("_far").alias("to")).write.parquet(f"{path}/{number}")
        now = spark.read.parquet(f"{path}/{number}")
    return now.where("kept").select("cell_id", "n")


def segment_rpt_runs(readings: DataFrame) -> DataFrame:
    """segment and kind: runs of one non-null ``rpt`` are RPT, runs of nulls Cycling; a run of one row has no segment."""
    rows = across(in_ranges(readings, READING), ["cell_id"], previous={"_before": "rpt"}, following={"_after": "rpt"}, spent=True)
    same = lambda side: F.col(side).isNotNull() & F.col("rpt").eqNullSafe(F.col(side)["v"])
    rows = rows.withColumns({"_new": (~same("_before")).cast("int"), "_alone": ~same("_before") & ~same("_after")})
    out = across(rows, ["cell_id"], totals={"segment": "_new"}, spent=True)
    out = out.withColumn("segment", F.when(~F.col("_alone"), F.col("segment")))
    return out.withColumn("kind", F.when(F.col("rpt").isNotNull(), "RPT").otherwise("Cycling")).drop("_new", "_before", "_after", "_alone", "_at", "_range")


def direction_runs(readings: DataFrame) -> DataFrame:
    """Runs of one current direction per cell, rest rows taking the direction before (at the start, after).

    Adds dir, run (from 0), _dt and the columns of ``in_ranges``.
    """
    rows = in_ranges(readings, READING)
    scale = group_quantiles(rows, ["cell_id"], F.abs("i"), {"_p": 0.9})
    eps = F.greatest(F.lit(1e-8), 0.02 * F.col("_p"))
    local = rows.select("cell_id", "_range").distinct().join(scale, "cell_id")  # a cell may span many ranges
    rows = rows.join(local, ["cell_id", "_range"]).withColumn("_s", F.when(F.col("i") > eps, 1).when(F.col("i") < -eps, -1))
    rows = across(rows, ["cell_id"], previous={"_before": "t"}, prior={"_back": "_s"}, spent=True)
    # rest rows have the direction before, so a run begins where a direction differs from the one known before
    first = rows.groupBy("cell_id").agg(F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("_at"))).alias("_ahead"))
    dt = F.greatest(F.coalesce(F.col("t") - F.col("_before.v"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"_dt": dt, "_new": F.coalesce((F.col("_s") != F.col("_back")).cast("int"), F.lit(0))})
    rows = across(rows, ["cell_id"], totals={"run": "_new"}, constants=first, spent=True)
    rows = rows.withColumn("dir", F.coalesce("_s", "_back", "_ahead", F.lit(0)))
    return rows.select(*readings.columns, "dir", "run", "_dt", "_at", "_range")


def paired_runs(majors: DataFrame) -> DataFrame:
    """(cell_id, low, high, id): neighbours of opposite direction among (cell_id, run, dir), each in one pair, numbered from 0.

    A run closes a pair if it turns against one that is still open. So in a stretch of runs that each turn against
    the one before, every second one closes a pair: the state is the parity of the place in the stretch.
    """
    rows = in_ranges(majors.select("cell_id", "run", "dir", F.struct("run", "dir").alias("_own"), F.lit(1).alias("_one")), ["cell_id", "run"])
    rows = across(rows, ["cell_id"], previous={"_before": "_own"}, totals={"_place": "_one"}, spent=True)
    turns = F.coalesce(F.col("dir") == -F.col("_before.v.dir"), F.lit(False))
    rows = across(rows.withColumn("_begin", F.when(~turns, F.col("_place"))), ["cell_id"], known={"_from": "_begin"}, spent=True)
    closes = (F.col("_place") - F.col("_from")) % 2 == 1
    rows = across(rows.withColumn("_closes", closes.cast("int")), ["cell_id"], totals={"_n": "_closes"}, spent=True)
    return rows.where("_closes = 1").select("cell_id", F.col("_before.v.run").alias("low"), F.col("run").alias("high"), (F.col("_n") - 1).cast("int").alias("id"))


def nearest_interval(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell_id, run, full_cycle): the id of the interval of ``pairs`` that holds a run, else of the nearest one, the earlier one on ties, else 0.

    Intervals don't overlap, so one sweep in order that remembers the last and the next one that begins decides.
    """
    starts = pairs.select("cell_id", F.col("low").alias("run"), F.struct("low", "high", "id").alias("_start"))
    rows = in_ranges(runs.select("cell_id", "run").join(starts, ["cell_id", "run"], "left"), ["cell_id", "run"])
    rows = across(rows, ["cell_id"], known={"_last": "_start"}, upcoming={"_next": "_start"}, spent=True)
    run, last, following = F.col("run"), F.col("_last"), F.col("_next")
    nearer = F.when(last.isNull(), following["id"]).when(following.isNull() | (run - last["high"] <= following["low"] - run), last["id"]).otherwise(following["id"])
    return rows.select("cell_id", "run", F.coalesce(nearer, F.lit(0)).alias("full_cycle"))


def split_full_cycles(readings: DataFrame) -> DataFrame:
    """Add dir, run and full_cycle: pairs of opposite major runs are cycles, all other runs join the nearest one."""
    rows = direction_runs(readings)
    runs = rows.groupBy("cell_id", "run").agg(
        F.first("dir").alias("dir"), F.count(F.lit(1)).alias("points"), F.sum("_dt").alias("seconds"), (F.sum(F.abs("i") * F.col("_dt")) / 3600).alias("q")
    )
    runs = in_ranges(runs, ["cell_id", "run"])
    typical = group_quantiles(runs.where("q > 0"), ["cell_id"], F.col("q"), {"_m": 0.5})
    runs = across(runs, ["cell_id"], constants=typical, spent=True)
    least = F.greatest(F.lit(1e-4), 0.01 * F.coalesce("_m", F.lit(0.0)))
    majors = runs.where(~((F.col("points") < 5) | (F.col("seconds") < 60) | (F.col("q") < least)))
    marks = nearest_interval(runs, paired_runs(majors))
    # a run may be as long as its cell: its mark comes to each range of it
    local = rows.select("cell_id", "_range", "run").distinct().join(marks, ["cell_id", "run"])
    return rows.join(local, ["cell_id", "_range", "run"]).select(*[c for c in rows.columns if c not in ("_dt", "_at", "_range")], "full_cycle")


def rpt_throughput(segmented: DataFrame) -> DataFrame:
    """First row of each RPT run: order, rpt and throughput before it."""
    rows = across(in_ranges(segmented.withColumn("_own", F.struct("t", "segment")), READING), ["cell_id"], previous={"_before": "_own"}, spent=True)
    flow = F.greatest(-F.col("i"), F.lit(0.0)) * F.greatest(F.coalesce(F.col("t") - F.col("_before.v.t"), F.lit(0.0)), F.lit(0.0)) / 3600
    first = F.coalesce(F.col("segment") != F.col("_before.v.segment"), F.col("segment").isNotNull())
    rows = across(rows.withColumns({"_flow": flow, "_first": first}), ["cell_id"], totals={"_sum": "_flow"}, spent=True)
    starts = rows.where("_first and kind = 'RPT'").withColumn("throughput", F.coalesce(F.col("_sum"), F.lit(0.0)) - F.coalesce(F.col("_flow"), F.lit(0.0)))
    starts = starts.select("cell_id", "rpt", "throughput", "cycle_number", "idx", F.lit(1).alias("rpt_order"))
    starts = across(in_ranges(starts, READING), ["cell_id"], totals={"_order": "rpt_order"}, spent=True)
    return starts.select("cell_id", F.col("_order").cast("int").alias("rpt_order"), "rpt", "throughput", "cycle_number", "idx")


def cycle_attribute(readings: DataFrame) -> DataFrame:
    """Step descriptions in first-seen order, and RPT or Cycling by what they say."""
    firsts = readings.groupBy(*CYCLE, "description").agg(F.min("idx").alias("_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "description"))), lambda x: x["description"])
    out = firsts.groupBy(*CYCLE).agg(F.concat_ws(" | ", listed).alias("step_description"))
    low = F.lower("step_description")
    rpt = low.contains("test capacity") | low.contains("capacity test") | (low.contains("1.0c charge") & low.contains("0.5c discharge"))
    return out.withColumn("attribute", F.when(rpt, "RPT").otherwise("Cycling"))


def phase_slices(readings: DataFrame, nominal: float, discharge_first: bool = False) -> DataFrame:
    """Long form with phase: the first phase up to its last active row (excluded), then the active rows of the other."""
    c = F.col("i") / nominal
    last = F.max(F.when((c <= -ACTIVE) if discharge_first else (c >= ACTIVE), F.col("idx"))).over(whole_cycle())
    out = readings.withColumn("_end", last).withColumn("_c", c)
    one, two = ("discharge", "charge") if discharge_first else ("charge", "discharge")
    phase = F.when(F.col("idx") < F.col("_end"), one).when((F.col("idx") >= F.col("_end")) & (F.abs("_c") > ACTIVE), two)
    return out.withColumn("phase", phase).where("phase is not null").drop("_end", "_c")


def masked_trim(readings: DataFrame, nominal: float, column: str, mask: Column, tol: float = 1e-2) -> DataFrame:
    """Normalised ``column`` of the masked rows, from the first small rising one to after the last rising one."""
    rows = readings.where(mask).withColumn("value", F.col(column) / nominal)
    up = F.lead("value").over(in_cycle()) > F.col("value")
    rows = rows.withColumn("_up", F.coalesce(up, F.lit(False))).withColumn("_n", F.row_number().over(in_cycle()))
    rows = rows.withColumn("_start", F.min(F.when(F.col("_up") & (F.col("value") < tol), F.col("_n"))).over(whole_cycle()))
    rows = rows.withColumn("_end", F.max(F.when(F.col("_up"), F.col("_n"))).over(whole_cycle()) + 1)
    return rows.where(F.col("_n").between(F.col("_start"), F.col("_end"))).drop("_up", "_n", "_start", "_end")


def drop_cycle_after_rpt(cycles: DataFrame, rpt: DataFrame) -> DataFrame:
    """Each reference test removes the first later cycle; at most one a cycle; then renumber.

    ``cycles`` has start, which doesn't fall from cycle to cycle, ``rpt`` is (cell_id, start); both times in one unit.
    Tests are arrivals in a queue that each cycle serves once if it can: of k cycles with a(k) tests before the k-th,
    k + min(0, a(1) - 1, ..., a(k) - k) have been served, so a cycle goes if that number grows with it.
    """
    tests = rpt.select("cell_id", "start", F.lit(1).alias("_test"))
    both = cycles.withColumn("_test", F.lit(0)).unionByName(tests, allowMissingColumns=True)
    # a test at the very start of a cycle isn't before it
    order = Window.partitionBy("cell_id").orderBy("start", "_test", "cycle_number")
    placed = both.withColumns({"_a": F.sum("_test").over(_running(order)), "_k": F.sum(1 - F.col("_test")).over(_running(order))})
    placed = placed.where("_test = 0").withColumn("_spare", F.least(F.lit(0), F.min(F.col("_a") - F.col("_k")).over(_running(order))))
    served = F.col("_k") + F.col("_spare")
    kept = placed.withColumn("_keep", served == F.coalesce(F.lag(served).over(order), F.lit(0))).where("_keep")
    return kept.select(*cycles.columns).withColumn("cycle_number", F.row_number().over(in_cell()))

"""Quantiles, windows and folds along groups that span many ranges, against plain loops."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cyclespark.functions import quantiles, scans, sliding
from cyclespark.functions.quantiles import group_quantiles, ordered_bits
from cyclespark.functions.scans import across, in_ranges, ranged_fold
from cyclespark.functions.sliding import sliding_medians
from cyclespark.operators import checks, clean, cohort, curves, segment, timeaxis
from cyclespark.sources import readers
from cyclespark.streaming import ingest


@pytest.fixture
def ranges(spark):
    """Ranges stay as many as shuffle partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(seed: int, n: int = 1600):
    """(cell_id, cycle_number, idx, t, i): one cell has half of the rows, others few, some one."""
    rng = random.Random(seed)
    cells = ["hot"] * (n // 2) + [f"c{rng.randrange(60)}" for _ in range(n // 2)]
    at: dict[str, int] = {}
    out = []
    for c in cells:
        k = at[c] = at.get(c, 0) + 1
        t = rng.choice([k * 1.0, k * 1.0, k * 1.0 - rng.randrange(30), k + 200.0, 7.0])
        out.append((c, (k - 1) // 50 + 1, (k - 1) % 50 + 1, t, rng.choice([2.0, 2.0, -1.5, 0.0])))
    return out


SCHEMA = "cell_id string, cycle_number int, idx int, t double, i double"


def by_cell(rows):
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        out.setdefault(r[0], []).append(r)
    return out


def test_ordered_bits(spark):
    rng = random.Random(1)
    special = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 * 0.99, 1.0, 2.0, 4.0, 1 - 2**-53, 1 + 2**-52, math.inf, -math.inf, 1.7976931348623157e308, math.nan, 1e-310, 8.0, 2.0**52, 2.0**53 - 1]
    values = special + [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-5, 5) for _ in range(500)] + [2.0**k for k in range(-1074, 1024)]
    values = [v for v in values if v == v] + [math.nan]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    for r in got:
        if r["x"] == r["x"]:
            bits = struct.unpack("q", struct.pack("d", abs(r["x"])))[0]
            assert r["b"] == (-bits if r["x"] < 0 else bits), r["x"]
    assert max(got, key=lambda r: r["b"])["x"] != max(got, key=lambda r: r["b"])["x"]


@pytest.mark.parametrize("few", [0, 50, 20_000])
def test_quantiles(spark, monkeypatch, few):
    """By counters down to the last bit, by sorting what few bits leave, and both."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.5, -3.0, 1e-300, None])) for _ in range(3000)]
    rows += [(f"g{rng.randrange(40)}", rng.uniform(-9, 9)) for _ in range(400)] + [("same", 4.25)] * 300 + [("one", 7.0), ("none", None), ("none", None), (None, 1.0), (None, 2.0)]
    rows += [("close", 1 + k * 2.0**-52) for k in range(101)] + [("inf", math.inf), ("inf", -math.inf), ("inf", 1.0), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q10": 1.0}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], F.col("x"), wanted).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("x", q).alias(n) for n, q in wanted.items()]).collect()}
    assert got.keys() == want.keys()
    for g in want:
        for n in wanted:
            assert got[g][n] == want[g][n] or (got[g][n] != got[g][n] and want[g][n] != want[g][n]) or got[g][n] == pytest.approx(want[g][n], rel=1e-15), (g, n)
    assert group_quantiles(df.limit(0), ["g"], F.col("x"), wanted).collect() == []


def test_across(ranges):
    rows = hot_rows(3)
    df = ranges.createDataFrame([(*r[:4], r[4] or None) for r in rows], SCHEMA).repartition(3)
    per_cell = df.groupBy("cell_id").agg(F.max("t").alias("top"))
    ranged = in_ranges(df, segment.READING)
    assert ranged.select("_range").distinct().count() >= 6
    assert ranged.where("cell_id = 'hot'").select("_range").distinct().count() >= 3
    got = across(ranged, ["cell_id"], previous={"p": "i"}, following={"f": "i"}, totals={"s": "t", "n": "i"}, known={"k": "i"}, upcoming={"u": "i"}, constants=per_cell)
    w = Window.partitionBy("cell_id").orderBy("cycle_number", "idx")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        *segment.READING, F.lag(F.struct(F.col("i").alias("v"))).over(w).alias("p"), F.lead(F.struct(F.col("i").alias("v"))).over(w).alias("f"), F.sum("t").over(up).alias("s"), F.sum("i").over(up).alias("n"),
        F.last("i", ignorenulls=True).over(up).alias("k"), F.first("i", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("u"), F.max("t").over(Window.partitionBy("cell_id")).alias("top"),
    )
    key = lambda r: tuple(r[c] for c in segment.READING)
    a, b = sorted(got.select(*want.columns).collect(), key=key), sorted(want.collect(), key=key)
    assert a == b


def test_times_of_a_hot_cell(ranges):
    rows = hot_rows(4)
    rows[5] = (*rows[5][:3], None, 1.0)
    df = ranges.createDataFrame(rows, SCHEMA).repartition(3)
    strict, spikes, falls = {}, set(), set()
    for c, own in by_cell(rows).items():
        last = accepted = None
        for k, r in enumerate(own):
            t = r[3]
            if t is not None:
                last = t if last is None or t > last else last + 1e-6
                if accepted is None or not t - accepted > 100:
                    accepted = t
                    spikes.add(r[:3])
            else:
                last = None if last is None else last + 1e-6
                spikes.add(r[:3])
            strict[r[:3]] = last
            if k + 1 < len(own) and t is not None and own[k + 1][3] is not None and own[k + 1][3] < t:
                falls.add(r[:3])
    got = timeaxis.strictly_increasing_time(df).collect()
    assert {tuple(r)[:3]: r["t_strict"] for r in got} == strict and len(got) == len(rows)
    assert {tuple(r)[:3] for r in timeaxis.drop_time_spikes(df, 100).collect()} == spikes
    assert {tuple(r)[:3] for r in timeaxis.time_descents(df).collect()} == falls


def test_wrong_leaps_are_corrected(ranges):
    """A fold whose leap says nothing true ends right."""
    rows = hot_rows(5, 400)

    def step(now, t):
        now = (now or 0.0) * 0.5 + t
        return now, now

    df = ranges.createDataFrame(rows, SCHEMA)
    got = ranged_fold(df, ["cell_id"], ["cycle_number", "idx"], ["t"], "y", "double", "double", step, {"n": F.count(F.lit(1))}, lambda now, end, facts: -1.0)
    want = {}
    for own in by_cell(rows).values():
        now = 0.0
        for r in own:
            want[r[:3]] = now = now * 0.5 + r[3]
    assert {tuple(r)[:3]: r["y"] for r in got.collect()} == want


def test_runs_and_throughput_of_a_hot_cell(ranges):
    rng = random.Random(6)
    rows = [(*r, rng.choice([None, 1, 1, 2])) for r in hot_rows(6)]
    df = ranges.createDataFrame(rows, SCHEMA + ", rpt int").repartition(3)
    runs, starts = {}, []
    for c, own in by_cell(rows).items():
        total, seg, order = 0.0, 0, 0
        for k, r in enumerate(own):
            new = k == 0 or own[k - 1][5] != r[5]
            alone = new and (k + 1 == len(own) or own[k + 1][5] != r[5])
            seg += new
            runs[r[:3]] = None if alone else seg
            before = runs[own[k - 1][:3]] if k else None
            first = runs[r[:3]] is not None if before is None or runs[r[:3]] is None else runs[r[:3]] != before
            if first and runs[r[:3]] is not None and r[5] is not None:
                order += 1
                starts.append((c, order, r[5], total))
            elif first and runs[r[:3]] is None and r[5] is not None:
                raise AssertionError
            dt = max(r[3] - own[k - 1][3], 0.0) if k else 0.0
            total += max(-r[4], 0.0) * dt / 3600
            if starts and starts[-1][0] == c and starts[-1][1] == order and first and runs[r[:3]] is not None and r[5] is not None:
                starts[-1] = (*starts[-1][:3], total - max(-r[4], 0.0) * dt / 3600)
    got = segment.segment_rpt_runs(df)
    assert {tuple(r)[:3]: r["segment"] for r in got.collect()} == runs
    found = sorted((r["cell_id"], r["rpt_order"], r["rpt"], r["throughput"]) for r in segment.rpt_throughput(got).collect())
    starts.sort()
    assert [x[:3] for x in found] == [x[:3] for x in starts]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in starts])


def plain_full_cycles(own):
    """full_cycle of each row of one cell: pairs by a loop with one open run, other runs by the nearest run that has a cycle."""
    eps = max(1e-8, 0.02 * float(np.percentile([abs(r[4]) for r in own], 90)))
    state = [1 if r[4] > eps else -1 if r[4] < -eps else None for r in own]
    known = next((s for s in state if s is not None), 0)
    runs, of = [], []
    for k, s in enumerate(state):
        known = s if s is not None else known
        if not runs or runs[-1]["dir"] != known:
            runs.append({"dir": known, "points": 0, "seconds": 0.0, "q": 0.0})
        dt = max(own[k][3] - own[k - 1][3], 0.0) if k else 0.0
        runs[-1]["points"] += 1
        runs[-1]["seconds"] += dt
        runs[-1]["q"] += abs(own[k][4]) * dt / 3600
        of.append(len(runs) - 1)
    some = [r["q"] for r in runs if r["q"] > 0]
    least = max(1e-4, 0.01 * (float(np.median(some)) if some else 0.0))
    number, open_, cycles = {}, None, 0
    for k, r in enumerate(runs):
        if r["points"] < 5 or r["seconds"] < 60 or r["q"] < least:
            continue
        if open_ is not None and r["dir"] == -runs[open_]["dir"]:
            number |= dict.fromkeys(range(open_, k + 1), cycles)
            cycles, open_ = cycles + 1, None
        else:
            open_ = k
    held = sorted(number)
    return [number.get(k, number[min(held, key=lambda h: (abs(h - k), h))] if held else 0) for k in of]


def test_full_cycles_of_a_hot_cell(ranges):
    rng = random.Random(7)
    rows = []
    for c, n in [("hot", 4000), *[(f"c{k}", rng.randrange(1, 40)) for k in range(100)]]:
        left, way, t = 0, 1.0, 0.0
        for k in range(n):
            if not left:
                left, way = rng.choice([1, 2, 5, 6, 9]), rng.choice([-way, -way, way, 0.0 if c != "hot" else -way]) or 1.0
            left -= 1
            t += rng.choice([1.0, 20.0, 30.0])
            rows.append((c, k // 50 + 1, k % 50 + 1, t, rng.choice([way, way, way * 1.5, 0.0])))
    got = {tuple(r)[:3]: r["full_cycle"] for r in segment.split_full_cycles(ranges.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {}
    for own in by_cell(rows).values():
        want |= dict(zip((r[:3] for r in own), plain_full_cycles(own), strict=True))
    assert got == want


def test_ten_thousand_runs(ranges):
    """Runs of one cell, pulses between them, and no join by range in the plan."""
    rng = random.Random(8)
    ways = [rng.choice([-1, 1]) for _ in range(10_000)]
    majors = [(("c"), 3 * k + rng.randrange(3), w) for k, w in enumerate(ways)]
    pairs, open_ = [], None
    for _, run, way in majors:
        if open_ is not None and way == -open_[1]:
            pairs.append(("c", open_[0], run, len(pairs)))
            open_ = None
        else:
            open_ = (run, way)
    found = segment.paired_runs(ranges.createDataFrame(majors, "cell_id string, run int, dir int"))
    assert sorted(tuple(r) for r in found.collect()) == pairs
    runs = ranges.range(30_010).select(F.lit("c").alias("cell_id"), F.col("id").cast("int").alias("run"))
    marks = segment.nearest_interval(runs, found)
    inside = {r["run"]: r["full_cycle"] for r in marks.collect()}
    assert all(inside[x] == k for _, low, high, k in pairs for x in range(low, high + 1)) and len(inside) == 30_010
    assert "NestedLoop" not in marks._jdf.queryExecution().toString()


@pytest.mark.parametrize("quiet", [0, 3, 40])
def test_chained_marks(spark, quiet):
    rng = random.Random(quiet)
    rows = [(c, n) for c in ("a", "b", "c") for n in sorted(rng.sample(range(900), 300))] + [("one", 4)]
    want = []
    for c in ("a", "b", "c", "one"):
        last = None
        for n in (n for x, n in rows if x == c):
            if last is None or n <= quiet or n - last > quiet:
                want.append((c, n))
                last = n
    got = segment._chained(spark.createDataFrame(rows, "cell_id string, n int"), quiet)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cycle_ends_of_a_hot_cell(ranges):
    rng = random.Random(13)
    rows = [(c, k, rng.choice([1.0, -1.0, -1.0, -1.0, -1.0, -9.0])) for c, n in (("hot", 1500), *((f"c{j}", 37) for j in range(30))) for k in range(n)]
    got = {(r["cell_id"], r["n"]) for r in segment.find_cycle_ends(ranges.createDataFrame(rows, "cell_id string, n int, i double").repartition(3), lag=4, tolerance=3, quiet=20).where("cycle_end").collect()}
    want = set()
    for c in {r[0] for r in rows}:
        own = [i for d, _, i in rows if d == c]
        odd = [0 < k < len(own) - 1 and abs(x - own[k - 1]) > 3 and abs(x - own[k + 1]) > 3 for k, x in enumerate(own)]
        flat = [own[k + 1] if odd[k] else x for k, x in enumerate(own)]
        run, last = 0, None
        for k, x in enumerate(flat):
            run = run + 1 if x < 0 else 0
            if run == 4:
                n = k - 3
                if last is None or n <= 20 or n - last > 20:
                    want.add((c, n))
                    last = n
    assert got == want and len(want) > 40


def test_queue_of_reference_tests(spark):
    rng = random.Random(9)
    cycles, tests, want = [], [], []
    for c in ("a", "b", "c", "none"):
        starts = sorted(rng.uniform(0, 100) for _ in range(50))
        own = sorted(rng.choice([rng.uniform(0, 100), rng.choice(starts)]) for _ in range({"a": 5, "b": 40, "c": 90, "none": 0}[c]))
        k, number = 0, 0
        for n, s in enumerate(starts):
            cycles.append((c, n + 1, s))
            if k < len(own) and own[k] < s:
                k += 1
            else:
                number += 1
                want.append((c, number, s))
        tests += [(c, x) for x in own]
    got = segment.drop_cycle_after_rpt(spark.createDataFrame(cycles, "cell_id string, cycle_number int, start double"), spark.createDataFrame(tests, "cell_id string, start double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# --- records of bounded size ---------------------------------------------------------------


def test_chunks_of_a_hot_cell(ranges):
    rows = hot_rows(10)
    df = ranges.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1.0) for c in ("v", "qc", "qd", "temp")}).repartition(3)
    nested = readers.nest_readings(df, size=70)
    assert {r["cell_id"]: r["n"] for r in nested.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {c: -(-len(own) // 70) for c, own in by_cell(rows).items()}
    assert nested.agg(F.max(F.size("points"))).first()[0] == 70
    assert sorted(tuple(r) for r in readers.unnest_readings(nested).select("cell_id", "cycle_number", "idx", "t", "i").collect()) == sorted(rows)
    places = {tuple(r) for r in readers.from_chunks(nested).select("cell_id", "cycle_number", "idx", "place").collect()}
    assert places == {(*r[:3], k) for own in by_cell(rows).values() for k, r in enumerate(own)}
    times = timeaxis.cumulative_time_array(df, size=33).collect()
    for c, own in by_cell(rows).items():
        parts = sorted((r for r in times if r["cell_id"] == c), key=lambda r: r["chunk"])
        assert [t for r in parts for t in r["times"]] == [r[3] for r in own]
        assert [r["first"] for r in parts] == list(range(0, len(own), 33))
    assert readers.nest_readings(df.limit(0)).collect() == []


def test_flattened_cycles(spark):
    rows = [("a", c, k, None if k == 3 else float(k), 1.0, 2.0, 10.0 * c + k) for c in (1, 2, 3) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "cell_id string, cycle_number int, idx int, v double, i double, qd double, t double")
    got = sorted(checks.flatten_for_inspection(df, 2, size=3).collect(), key=lambda r: r["chunk"])
    assert [t for r in got for t in r["t"]] == [11.0, 12.0, 13.0, 21.0]
    assert [r["n"] for r in got] == [4, 4] and [r["first"] for r in got] == [0, 3]


# --- ingestion -------------------------------------------------------------------------------


def test_ingest_counts_once_and_restarts(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    spark.range(10).write.parquet(source)
    calls = spark.sparkContext.accumulator(0)

    def seen(df):
        return df.mapInPandas(lambda it: (calls.add(len(b)) or b for b in it), "id long")

    assert ingest.ingest_new_files(spark, source, "id long", target, marks, seen) == 10
    assert calls.value == 10  # every row went through the pipeline once
    assert ingest.ingest_new_files(spark, source, "id long", target, marks, seen) == 0
    spark.range(10, 15).write.mode("append").parquet(source)

    def breaks(df):
        raise ValueError("no")

    with pytest.raises(Exception):  # noqa: B017
        ingest.ingest_new_files(spark, source, "id long", target, marks, breaks)
    assert sorted(r["rows"] for r in ingest.committed(spark, target).collect()) == [10]
    assert ingest.ingest_new_files(spark, source, "id long", target, marks, seen) == 5
    assert sorted(r["rows"] for r in ingest.committed(spark, target).collect()) == [5, 10]
    assert sorted(r["id"] for r in ingest.read_committed(spark, target, "id long, batch long").collect()) == list(range(15))
    # a batch without its line in the manifest isn't seen
    spark.range(100, 101).write.parquet(f"{target}/batch=77")
    assert ingest.read_committed(spark, target, "id long, batch long").count() == 15
    assert ingest.committed(spark, f"{tmp_path}/none").collect() == []


# --- rules and kernels -----------------------------------------------------------------------


def test_rules_of_several_conditions(spark):
    rng = random.Random(11)
    parts = ["a1", "b2", "c3", "d4", "_5", "x"]
    rules = []
    for k in range(60):
        clauses = [rng.sample(parts, rng.randrange(1, 4)) for _ in range(rng.randrange(0, 4))]
        rules.append((k * 3, rng.choice(["P", "Q"]), rng.choice([clauses, clauses, None]), rng.choice([[], None, rng.sample(parts, 2)]), 1000 + k))
    names = {f"{rng.choice('PQR')}_" + "".join(rng.sample(parts, rng.randrange(0, 6))) for _ in range(400)}
    cells = spark.createDataFrame([(n,) for n in names], "cell_id string").withColumn("prefix", F.substring("cell_id", 1, 1))
    frame = spark.createDataFrame(rules, "ord int, prefix string, clauses array<array<string>>, excluded array<string>, id int")
    got = {(r["cell_id"], r["ord"], r["id"]) for r in cohort.matching_rules(cells, frame).collect()}
    want = {
        (n, o, i) for n in names for o, p, clauses, barred, i in rules
        if n[0] == p and all(any(x in n for x in c) for c in clauses or []) and not any(x in n for x in barred or [])
    }
    assert got == want


def test_kernel_sums_of_a_full_bin(spark):
    rng = np.random.default_rng(12)
    full, wide = rng.uniform(500.0, 500.6, 100_000), np.concatenate([rng.uniform(-3000, 3000, 300), [500.3, 500.3, 1e5]])
    values = np.concatenate([full, wide])
    h = 1.0
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "label double").repartition(8)
    got = {r["label"]: r["p"] for r in curves.kernel_sums(df, h).collect()}
    assert len(got) == len(set(values))
    for x in [*rng.choice(full, 40), *wide]:
        want = float(np.exp(-((x - values) ** 2) / (2 * h * h)).sum())
        assert got[x] == pytest.approx(want, rel=1e-6, abs=1e-6 * len(values) * 1e-3)
    sizes = rng.uniform(0, 40, 700)
    narrow = curves.density_weight(spark.createDataFrame([(float(x),) for x in sizes], "label double"), 3.0)
    p = np.exp(-((sizes[:, None] - sizes[None]) ** 2) / 18).sum(1)
    w = np.maximum(1 - (p - p.min()) / (p.max() - p.min()), 1e-6)
    assert {r["label"]: r["weight"] for r in narrow.collect()} == pytest.approx(dict(zip(sizes.tolist(), (w / w.mean()).tolist(), strict=True)), abs=1e-6)


# --- sliding medians ---------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "pad"), [(1, None), (2, None), (5, None), (21, 0.0), (64, None)])
def test_sliding_medians(spark, monkeypatch, length, pad):
    monkeypatch.setattr(sliding, "CHUNK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rng = random.Random(length)
    cells = {"hot": 400, "short": 3, "one": 1, "even": 128}
    rows = [(c, k, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), 0.5, None, -2.0])) for c, n in cells.items() for k in range(n)]
    got = {(r["c"], r["start"]): r["median"] for r in sliding_medians(spark.createDataFrame(rows, "c string, p int, x double"), ["c"], "p", F.col("x"), length, pad).collect()}
    for c, n in cells.items():
        own = [x for d, _, x in rows if d == c]
        for start in range(1 - length, n):
            seen = [own[k] if 0 <= k < n else None for k in range(start, start + length)]
            seen = [pad if x is None else x for x in seen]
            seen = [x for x in seen if x is not None]
            assert got[c, start] == (pytest.approx(float(np.median(seen))) if seen else None), (c, start)
        assert sum(c == d for d, _ in got) == n + length - 1
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_groups_read_their_source_once(spark):
    """E3 writes the distances instead of computing them for each round; the median of small groups takes no rounds."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(c, k, float((k * 7 + c) % 13)) for c in range(3) for k in range(1, 41)]
    source = spark.createDataFrame(rows, "cell_id long, cycle_number int, qd_max double").mapInPandas(count, "cell_id long, cycle_number int, qd_max double")
    assert clean.hampel_shift_outliers(source, 3).count() == len(rows)
    assert seen.value == len(rows)


def test_direction_runs_write_few_tables(spark, monkeypatch):
    """D11: ranges, and two passes over them."""
    written = []
    stored = scans._stored
    monkeypatch.setattr(scans, "_stored", lambda df, name: written.append(name) or stored(df, name))
    rows = [("c", 1, k, float(k), float((-1) ** (k // 4)) * (k % 3)) for k in range(40)]
    out = segment.direction_runs(spark.createDataFrame(rows, "cell_id string, cycle_number int, idx int, t double, i double"))
    assert out.count() == 40 and written == ["ranges", "across", "across"]

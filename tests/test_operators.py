"""Golden values, folds against plain loops, and edge rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclespark.functions import parse
from cyclespark.operators import clean, curves, life, metrics, segment, timeaxis

READING = "cell_id string, cycle_number int, idx int, t double, i double"


def frame(spark, ts, currents=None, cell="c", cycle=1):
    currents = currents or [0.0] * len(ts)
    return spark.createDataFrame([(cell, cycle, k + 1, float(t), float(c)) for k, (t, c) in enumerate(zip(ts, currents, strict=True))], READING)


def column(df, name, order=("cycle_number", "idx")):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_time_reset(spark):
    out = timeaxis.fix_time_resets(frame(spark, [0, 100, 200, 0, 100, 200]))
    assert column(out, "t") == [0, 100, 200, 200, 300, 400]


def test_step_capacity(spark):
    rows = zip([1, 1, 2, 2, 3, 3, 4], ["charge", "charge", "rest", "charge", "charge", "charge", "discharge"], [0.1, 0.2, 0.0, 0.1, 0.1, 0.2, 0.0], strict=True)
    df = spark.createDataFrame([("c", 1, k + 1, s, n, r, 0.0) for k, (s, n, r) in enumerate(rows)], "cell_id string, cycle_number int, idx int, step int, kind string, raw double, raw_qd double")
    got = column(segment.accumulate_step_capacity(df), "qc")
    assert got == pytest.approx([0.1, 0.2, 0.2, 0.3, 0.4, 0.5, 0.0])


def test_compress(spark):
    df = frame(spark, range(5), [0, 0, -1, -1, 1])
    row = segment.compress_stages(segment.classify_stage(df, 1.0)).first()
    assert row["stages"] == ["rest", "discharge", "charge"] and not row["odd"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", y, p) for y, p in zip([3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0], strict=True)], "g string, y double, yhat double")
    row = metrics.regression_metrics(df, ["g"]).first()
    assert row["mae"] == 0.5 and row["mape"] == pytest.approx(0.3273809523809524)


def test_weighted_multioutput(spark):
    y, p = [[0.0, 2.0], [-1.0, 2.0], [8.0, -5.0]], [[0.5, 1.0], [-1.0, 1.0], [7.0, -6.0]]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(y, p, strict=True)], "w int, y array<double>, yhat array<double>")
    assert [r["mae"] for r in metrics.weighted_multioutput_metrics(df).orderBy("output").collect()] == [0.5, 1.0]
    assert metrics.weighted_multioutput_metrics(df, average=True).first()["mae"] == 0.75


def test_strictly_increasing(spark):
    ts = [0, 0, 1, 1, 0.5, 3]
    got = column(timeaxis.strictly_increasing_time(frame(spark, ts)), "t_strict")
    last, want = None, []
    for t in ts:
        last = t if last is None or t > last else last + 1e-6
        want.append(last)
    assert got == want


def test_time_spikes(spark):
    got = column(timeaxis.drop_time_spikes(frame(spark, [0, 10, 500, 20, 121, 30]), 100), "idx")
    assert got == [1, 2, 4, 6]


def test_capped_count(spark):
    random.seed(3)
    currents = [random.choice([-2.0, 0.0, 3.0]) for _ in range(60)]
    ts = [600.0 * k for k in range(60)]
    got = segment.coulomb_count_capped(frame(spark, ts, currents))
    for name, sign in (("qc", 1), ("qd", -1)):
        q = [0.0]
        for k in range(1, 60):
            v = q[-1] + (sign * currents[k] * 600 / 3600 if sign * currents[k] > 0 else 0)
            q.append(v if v < 2 else 0.0)
        assert column(got, name) == pytest.approx(q)


def test_cycle_ends(spark):
    random.seed(4)
    currents = [random.choice([1.0, -1.0, -1.0, -1.0]) for _ in range(200)]
    df = spark.createDataFrame([("c", k, c) for k, c in enumerate(currents)], "cell_id string, n int, i double")
    got = [r["n"] for r in segment.find_cycle_ends(df, lag=3, tolerance=10, quiet=12).where("cycle_end").orderBy("n").collect()]
    run, marks = 0, []
    for k, c in enumerate(currents):
        run = run + 1 if c < 0 else 0
        if run == 3:
            t = k - 2
            if not (t > 12 and any(t - 12 <= m < t for m in marks)):
                marks.append(t)
    assert got == marks


def test_full_cycles(spark):
    currents = ([1.0] * 8 + [-1.0] * 8 + [0.0] * 2) * 3 + [1.0] * 2
    got = column(segment.split_full_cycles(frame(spark, [30.0 * k for k in range(len(currents))], currents)), "full_cycle")
    assert got[:16] == [0] * 16 and got[18:34] == [1] * 16 and got[36:52] == [2] * 16


def test_cycle_after_rpt(spark):
    cycles = spark.createDataFrame([("c", k, 10.0 * k) for k in range(1, 7)], "cell_id string, cycle_number int, start double")
    rpt = spark.createDataFrame([("c", 15.0), ("c", 16.0)], "cell_id string, start double")
    kept = segment.drop_cycle_after_rpt(cycles, rpt).orderBy("cycle_number").collect()
    assert [(r["cycle_number"], r["start"]) for r in kept] == [(1, 10.0), (2, 40.0), (3, 50.0), (4, 60.0)]


def test_resample_against_numpy(spark):
    import numpy as np

    x = [random.random() for _ in range(17)]
    df = spark.createDataFrame([(x,), ([2.0],)], "x array<double>").select(curves.resample_curve(F.col("x"), 30).alias("y"))
    a, b = (r["y"] for r in df.collect())
    assert a == pytest.approx(np.interp(np.linspace(1, 18, 30), np.arange(1, 18), x).tolist())
    assert b == [2.0] * 30


def test_augmentation_is_stable(spark):
    df = spark.createDataFrame([(k, [float(j) for j in range(32)]) for k in range(6)], "id long, x array<double>")
    y = df.select("id", curves.augment_cutout_jitter(F.col("x"), F.col("id")).alias("y"))
    assert sorted(map(str, y.collect())) == sorted(map(str, y.repartition(5).collect()))
    assert all(abs(v - j) <= 0.06 * j + 1e-9 for r in y.collect() for j, v in enumerate(r["y"]))
    mixed = curves.augment_freq_mix(curves.augment_freq_mask(df, "id", "x"), "id", "x")
    assert all(len(r["masked"]) == len(r["freq_mixed"]) == 32 for r in mixed.collect())


def test_impute(spark):
    df = spark.createDataFrame([("c", k, float(k)) for k in (2, 3, 5)], "cell_id string, cycle_number int, qd_max double")
    bad = spark.createDataFrame([("c", 1), ("c", 3), ("c", 4)], "cell_id string, cycle_number int")
    out = clean.impute_bad_cycles(df, bad).orderBy("cycle_number").collect()
    assert [(r[0], r["cycle_number"], r["qd_max"]) for r in out] == [("c", 1, 2.0), ("c", 2, 2.0), ("c", 3, 2.0), ("c", 4, 2.0), ("c", 5, 5.0)]


def test_parsing(spark):
    row = spark.createDataFrame([("b10", "b2", "-", "NaN", "5.4C(80%)-4.8C-new")], "a string, b string, dash string, nan string, p string").select(
        (parse.natural_key(F.col("b")) < parse.natural_key(F.col("a"))).alias("natural"),
        parse.to_number(F.col("dash"), True).alias("dash"), parse.to_number(F.col("nan")).alias("nan"), parse.charge_policy(F.col("p")).alias("p"),
        parse.soc_span(F.lit(0.0), F.lit(0.0), True).alias("span"),
    ).first()
    assert row["natural"] and row["dash"] == 0.0 and row["nan"] is None and row["span"] == 1.0
    assert [tuple(s) for s in row["p"]] == [(5.4, 0.0, 80.0), (4.8, 80.0, 1.0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], READING)
    assert timeaxis.fix_time_resets(empty).count() == 0
    assert segment.coulomb_count(empty).count() == 0
    assert timeaxis.strictly_increasing_time(empty).count() == 0


def test_point_adjust(spark):
    rows = [("s", k, t, p) for k, (t, p) in enumerate(zip([1, 1, 0, 1, 1, 1], [0, 1, 0, 0, 0, 1], strict=True))]
    out = metrics.point_adjust(spark.createDataFrame(rows, "series string, idx int, truth int, pred int"))
    assert column(out, "adjusted", ("idx",)) == [0, 1, 0, 1, 1, 1]


def brute_mmd(x, side):
    """The two-sample statistic of all pairs, five kernels a factor of two apart."""
    import numpy as np

    d = ((x[:, None] - x[None]) ** 2).sum(2)
    width = d.sum() / (len(x) ** 2 - len(x)) / 4
    kernel = sum(np.exp(-d / (width * 2**k)) for k in range(5))
    a, b = side == 0, side == 1
    return kernel[a][:, a].mean() + kernel[b][:, b].mean() - 2 * kernel[a][:, b].mean()


@pytest.mark.parametrize("n, block_rows", [(60, 7), (60, 1), (61, 20), (60, 2048)])
def test_mmd_against_numpy(spark, n, block_rows):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(n, 6)) + np.arange(n)[:, None] % 2
    df = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(x)], "id long, side int, x array<double>")
    want = brute_mmd(x, np.arange(n) % 2)
    assert metrics.mmd_rbf(df, "x", block_rows=block_rows).first()["mmd"] == pytest.approx(want, rel=1e-9)
    assert metrics.mmd_rbf(df.where("side = 0"), "x").first()["mmd"] is None


def test_mmd_query_takes_the_whole_table(spark, small):
    import numpy as np

    from cyclespark.plans import registry

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, side = np.array([r[1] for r in rows], float), np.array([r[0] % 2 for r in rows])
    assert registry.queries()["j13_mmd_rbf"](spark, small).first()["mmd"] == pytest.approx(brute_mmd(x, side), abs=1e-8)


def test_mask_and_note_take_all_cycles(spark, small):
    from cyclespark.plans import fixtures, registry

    made = registry.queries()
    cycles = {}
    for r in fixtures.health(spark, small).select("cell_id", "cycle_number").collect():
        cycles.setdefault(r[0], []).append(r[1])
    assert max(map(max, cycles.values())) > 40
    masked = made["g05_apply_prefix_mask_all"](spark, small).collect()
    assert sorted((r["cell_id"], r["n_seen"], r["cycle_number"]) for r in masked) == sorted((c, n, k) for c, ks in cycles.items() for n in (5, 20) for k in ks)
    assert all((r["y"] == 0) == (r["cycle_number"] > r["n_seen"]) for r in masked)
    for r in made["g23_operating_note_all"](spark, small).collect():
        ks = sorted(cycles[r["cell_id"]])
        tests = [k for k in ks if r["cell_id"] % 2 and k % 10 == 0]
        text = ["Normal cycles: " + ", ".join(str(k) for k in ks if k not in tests), " Reference tests: " + ", ".join(map(str, tests)), ""]
        assert r["note"] == (".".join(text) if tests else "All cycles are normal cycles.")


def test_nested_json(spark, tmp_path, monkeypatch, small):
    """Files of one indented document each, files of one a line, and the query's own."""
    import json

    from cyclespark.plans import registry
    from cyclespark.sources import readers

    docs = [{"other": 1, "cycles_interpolated": {"voltage": [1.0, 2.5], "n": [3, 4]}}, {"cycles_interpolated": {"n": [5], "voltage": [7.0]}}]
    want = [(1, 1.0, 3), (1, 7.0, 5), (2, 2.5, 4)]
    for k, d in enumerate(docs):
        (tmp_path / "indented").mkdir(exist_ok=True)
        (tmp_path / "indented" / f"{k}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, docs)))
    for path, multi_line in ((tmp_path / "indented", True), (tmp_path / "lines.json", False)):
        got = readers.read_nested_json(spark, f"file://{path}", {"voltage": "double", "n": "int"}, multi_line=multi_line)
        assert sorted((r["idx"], r["voltage"], r["n"]) for r in got.collect()) == want
    used, read = [], readers.read_nested_json
    monkeypatch.setattr(readers, "read_nested_json", lambda *a, **b: used.append(a) or read(*a, **b))
    assert registry.queries()["a05_read_nested_json"](spark, small).count() > 0 and used


def test_life_model_scores_all_splits(spark, small):
    """The fit of the query against least squares in numpy."""
    import numpy as np

    from cyclespark.plans import evaluation_queries, registry

    df, features = evaluation_queries.life_samples(spark, small)
    rows = df.collect()
    assert len({r["cell_id"] for r in rows}) > 5 and {r["split"] for r in rows} == {"train", "val", "test"}
    x, y = np.array([[r[f] for f in features] for r in rows]), np.array([r["label"] for r in rows], float)
    split = np.array([r["split"] for r in rows])
    train = split == "train"
    label = np.array(sorted({(r["cell_id"], r["label"]) for r in rows if r["split"] == "train"}), object)[:, 1].astype(float)
    z = (y - label.mean()) / label.std()
    one = np.c_[np.ones(len(x)), x]
    got = {r["split"]: r for r in registry.queries()["j17_linear_life_model_curves"](spark, small).collect()}
    p = (one @ np.linalg.lstsq(one[train], z[train], rcond=None)[0]) * label.std() + label.mean()
    for s in ("train", "val", "test"):
        assert got[s]["n"] == (split == s).sum() and got[s]["mae"] == pytest.approx(np.abs(p - y)[split == s].mean(), rel=0.02)


def test_frequency_augmentation_against_numpy(spark):
    """Masking, mixing and dropout of frequencies against the same steps written with numpy."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    drawn = lambda k, n, rate: np.random.default_rng([k, 0]).random(n) < rate
    masked = {r["id"]: r["masked"] for r in curves.augment_freq_mask(df, "id", "x").collect()}
    dropped = {r["id"]: r["freq_dropped"] for r in curves.augment_freq_dropout(df, "id", "x").collect()}
    for k, v in enumerate(x):
        spectrum = np.fft.rfft(v)
        rank = np.argsort(-np.abs(spectrum), kind="stable")
        assert masked[k] == pytest.approx(np.fft.irfft(np.where(drawn(k, 17, 0.25) & (rank > 5), 0, spectrum), n=32))
        assert dropped[k] == pytest.approx(np.fft.irfft(np.where(drawn(k, 17, 0.5), 0, spectrum), n=32))
    two = df.where("id < 2").withColumn("id", F.col("id") * 0 + F.when(F.col("id") == 0, 3).otherwise(5))
    mixed = {r["id"]: np.fft.rfft(r["freq_mixed"]) for r in curves.augment_freq_mix(two, "id", "x").collect()}
    own = {3: np.fft.rfft(x[0]), 5: np.fft.rfft(x[1])}
    for k, spectrum in mixed.items():  # each frequency is the series' own or, where drawn, its successor's
        other = own[8 - k]
        swap = drawn(k, 17, 0.5)
        assert np.allclose(spectrum[~swap], own[k][~swap])
        assert np.allclose(spectrum[swap], own[k][swap]) or np.allclose(spectrum[swap], other[swap])


def test_cycle_curves_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows, parts = [], {}
    for cycle, (n, m) in enumerate([(5, 7), (12, 3), (4, 0)], 1):
        for phase, size in (("charge", n), ("discharge", m)):
            v, i, q = rng.uniform(3, 4, size), rng.normal(size=size), rng.uniform(0, 1, size)
            parts[cycle, phase] = (v, i, q)
            at = 0 if phase == "charge" else n
            rows += [("c", cycle, at + k + 1, phase, float(v[k]), float(i[k]), float(q[k]), float(q[k])) for k in range(size)]
    df = spark.createDataFrame(rows, "cell_id string, cycle_number int, idx int, phase string, v double, i double, qc double, qd double")
    got = {r["cycle_number"]: r for r in curves.cycle_curves(df.repartition(3), 1.1, 20).collect()}

    def resampled(x):
        n = len(x)
        return np.interp(np.linspace(1, n + 1, 10), np.arange(1, n + 1), x) if n else np.zeros(10)

    for cycle in (1, 2, 3):
        v, c, q = (np.concatenate([resampled(parts[cycle, p][k]) for p in ("charge", "discharge")]) for k in range(3))
        assert got[cycle]["v"] == pytest.approx(v / v.max()) and got[cycle]["c"] == pytest.approx(c / 1.1) and got[cycle]["q"] == pytest.approx(q / 1.1)


def test_placed(spark):
    """Places in order over many ranges, equal rows included."""
    from cyclespark.functions.windows import placed

    values = [random.Random(1).randint(0, 300) for _ in range(2000)]
    got = [(r["v"], r["at"]) for r in placed(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), ["v"], "at").orderBy("at").collect()]
    assert got == [(v, k + 1) for k, v in enumerate(sorted(values))]


def test_backfill_is_linear(spark):
    """A long cycle is filled back in one pass."""
    rows = spark.range(200_000).select(F.lit("c").alias("cell_id"), F.lit(1).alias("cycle_number"), (F.col("id") + 1).cast("int").alias("idx"), F.lit(0.5).alias("qc"), F.when(F.col("id") % 1000 == 999, 1.0).otherwise(-1.0).alias("qd"), F.col("id").cast("double").alias("v"))
    out = clean.mask_negative_and_bfill(rows, ["v"])
    assert out.where("v = ceil(idx / 1000D) * 1000 - 1").count() == 200_000


def test_flat_line_has_no_label(spark):
    """Two equal healths but for rounding: their line meets the end where no integer reaches."""
    h = spark.createDataFrame([("a", 82, 0.9306666666666668), ("a", 83, 0.9306666666666666), ("b", 1, 0.95), ("b", 2, 0.85)], "cell_id string, cycle_number int, soh double")
    assert sorted(map(tuple, life.life_first_crossing(h).collect())) == [("a", None), ("b", 3)]
    near = spark.createDataFrame([("a", k, 0.81 + k * 1e-14) for k in range(1, 4)], h.schema)
    assert [life.extrapolate_life(near).first()["eol"], life.life_label(near).first()["eol"], life.life_last_crossing(near).first()["eol"]] == [None] * 3


def test_reset_report_of_one_reading(spark):
    """As in SQL, a cycle without a step has no counts of steps; its sums are empty."""
    both = frame(spark, [5]).union(frame(spark, [5, 6], cell="d"))
    got = {r["cell_id"]: (r["resets"], r["gaps"], r["reset_at"], r["gap_list"]) for r in timeaxis.reset_report(both).collect()}
    assert got == {"c": (None, None, [], []), "d": (0, 0, [], [])}


def test_mmd_blocks():
    """Each block is shuffled once for each other one: few blocks for large tables, enough pairs for all tasks of small ones."""
    assert metrics._blocks(300_000, 16_384, 200) == 20  # 147 blocks of 2,048 rows before
    assert metrics._blocks(3_000_000, 16_384, 200) == 184
    assert metrics._blocks(10_000, 16_384, 8) == 4 and metrics._blocks(2_000, 16_384, 8) == 1
    assert metrics._blocks(100, 16, 8) == 7

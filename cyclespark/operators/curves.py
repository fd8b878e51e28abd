"""Curves, samples, features and augmentation (survey group G).

Arrays here are curves of bounded length (a few hundred points), so array functions fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.scans import across, in_ranges
from cyclespark.functions.windows import CYCLE
from cyclespark.sources.shared import scratch


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def resample_curve(values: Column, m: int) -> Column:
    """m points from place 1 to n+1 inclusive over the places 1..n, linear, clamped past n."""

    def one(x: Column) -> Column:
        n = F.size(x)

        def at(j: Column) -> Column:
            p = 1 + j * (n / F.lit(float(m - 1)))
            low = F.least(F.floor(p).cast("int"), n)
            a, b = F.get(x, low - 1), F.get(x, F.least(low, n - 1))
            return F.when(p >= n, F.get(x, n - 1)).otherwise(a + (b - a) * (p - low))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at))

    return let(values, one)


def cycle_curves(phases: DataFrame, nominal: float, length: int = 300) -> DataFrame:
    """v, c and q of each cycle: charge half, then discharge half; v over its maximum, c and q over nominal.

    ``phases`` is the long form with phase; capacity of a phase is qc or qd.
    """
    q = F.when(F.col("phase") == "charge", F.col("qc")).otherwise(F.col("qd"))
    rows = phases.withColumn("_p", F.struct("idx", "v", "i", q.alias("q")))
    halves = {p: F.array_sort(F.collect_list(F.when(F.col("phase") == p, F.col("_p")))) for p in ("charge", "discharge")}
    grouped = rows.groupBy(*CYCLE).agg(*[c.alias(f"_{p}") for p, c in halves.items()])
    half = length // 2

    def joined(name: str) -> Column:
        return F.concat(*[F.coalesce(resample_curve(F.transform(F.col(f"_{p}"), lambda x: x[name]), half), F.array_repeat(F.lit(0.0), half)) for p in halves])

    out = grouped.withColumns({"v": joined("v"), "c": joined("i"), "q": joined("q")})
    scale = lambda c, by: F.transform(c, lambda x: x / by)
    return out.select(*CYCLE, scale(F.col("v"), F.array_max("v")).alias("v"), scale(F.col("c"), F.lit(nominal)).alias("c"), scale(F.col("q"), F.lit(nominal)).alias("q"))


def pad_missing_cycles(curves: DataFrame, threshold: int, length: int, columns: list[str]) -> DataFrame:
    """Cycles 1..threshold of each cell; absent ones are zero curves."""
    all_ = curves.select("cell_id").distinct().withColumn("cycle_number", F.explode(F.sequence(F.lit(1), F.lit(threshold))))
    zero = F.array_repeat(F.lit(0.0), length)
    return all_.join(curves, CYCLE, "left").select(*CYCLE, *[F.coalesce(c, zero).alias(c) for c in columns])


def expand_samples(cells: DataFrame, seq_len: int, threshold: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """One sample for each number of seen cycles; ``cells``: cell_id, eol, valid_cycles."""
    rows = cells.where(F.col("eol") > threshold).withColumn("n_seen", F.explode(F.sequence(F.lit(seq_len), F.lit(threshold))))
    kept = rows.where((F.col("n_seen") < F.col("eol")) & (F.col("n_seen") <= F.col("valid_cycles")))
    if low is not None:
        kept = kept.where(F.col("n_seen") >= low)
    if high is not None:
        kept = kept.where(F.col("n_seen") <= high)
    return kept.select("cell_id", "n_seen", F.col("eol").alias("label"))


def prefix_mask(n_seen: Column, threshold: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(threshold)), lambda j: (j <= n_seen).cast("int"))


def apply_prefix_mask(samples: DataFrame, curves: DataFrame, columns: list[str]) -> DataFrame:
    """Curves of each sample, zeroed from the cycle after the last seen one."""
    both = samples.join(curves, "cell_id")
    seen = F.col("cycle_number") <= F.col("n_seen")
    return both.withColumns({c: F.when(seen, F.col(c)).otherwise(F.transform(c, lambda x: x * 0)) for c in columns})


def flatten_features(curves: DataFrame, columns: list[str]) -> DataFrame:
    """All curves of a cell, cycle after cycle, as one vector."""
    row = F.struct("cycle_number", F.concat(*columns).alias("x"))
    return curves.groupBy("cell_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])).alias("features"))


def nan_guard(curves: DataFrame, columns: list[str]) -> DataFrame:
    """Cells with a NaN or null inside a curve."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.exists(c, lambda x: x.isNull() | F.isnan(x))
    return curves.where(bad).select("cell_id").distinct()


def evenly_spaced(values: Column, n: int) -> Column:
    """n values at places int(i * len / n); null where there are fewer than n."""
    pick = let(values, lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, F.floor(i * F.size(x) / n).cast("int"))))
    return F.when(F.size(values) >= n, pick)


def relative_cycle_time(readings: DataFrame, positions: list[int]) -> DataFrame:
    """Readings of the cycles at the given places, time from each one's start."""
    chosen = readings.where(F.col("cycle_number").isin(positions))
    first = F.first("t").over(Window.partitionBy(*CYCLE).orderBy("idx"))
    return chosen.withColumn("t", F.col("t") - first)


def standardise_labels(samples: DataFrame, train: DataFrame) -> DataFrame:
    """label_z with mean and population deviation of one label per train cell; both are kept for the way back."""
    one = train.select("cell_id", "label").distinct().agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("std")).withColumn("_one", F.lit(1))
    both = samples.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")  # one row
    return both.withColumn("label_z", (F.col("label") - F.col("mean")) / F.col("std"))


def inverse_frequency_weight(samples: DataFrame, smooth: bool = False) -> DataFrame:
    """1/n of the dataset, or 1/ln(n / smallest n + 1)."""
    n = samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    least = F.min("_n").over(Window.partitionBy(F.lit(1)))  # one row a dataset
    weight = 1 / F.log(F.col("_n") / least + 1) if smooth else 1 / F.col("_n")
    return samples.join(n.select("dataset", weight.alias("weight")), "dataset")


#: Terms of the expansion around a bin's centre, width of a bin and reach of a kernel in bandwidths.
TERMS, BIN, REACH = 12, 0.5 * math.sqrt(2), 8


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the physicists' Hermite polynomials H_0, H_1, ..., lowest power first."""
    rows = [[1.0], [0.0, 2.0]]
    for n in range(1, terms - 1):
        rows.append([2 * a - 2 * n * b for a, b in zip([0.0, *rows[n]], [*rows[n - 1], 0.0, 0.0], strict=True)])
    return [[*r, *[0.0] * (terms - len(r))] for r in rows[:terms]]


def kernel_sums(labels: DataFrame, bandwidth: float, salts: int = 32) -> DataFrame:
    """label and p, the sum of Gaussian kernels of all labels, for each distinct label, in linear time (fast Gauss transform).

    The labels of a bin act through their moments: sums of powers of the distance from its centre, which weight a Hermite
    expansion. A label meets the bins within ``REACH`` bandwidths instead of labels. Error: at most 2e-10 of the number of labels
    for the terms left out and 2e-14 for the bins. Labels of one bin are dealt over ``salts`` tasks; null labels go.
    """
    scale = math.sqrt(2) * bandwidth
    width = BIN * bandwidth
    centre = (F.col("bin") + 0.5) * width
    counted = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("bin", F.floor(F.col("label") / width).cast("long"))
    u = (F.col("label") - centre) / scale
    moments = counted.groupBy("bin").agg(*[(F.sum(F.col("n") * F.pow(u, F.lit(float(k)))) / math.factorial(k)).alias(f"_{k}") for k in range(TERMS)])
    rows = _hermite(TERMS)
    powers = F.array(*[sum((F.col(f"_{n}") * rows[n][k] for n in range(TERMS) if rows[n][k]), F.lit(0.0)) for k in range(TERMS)])
    bins = moments.select(F.col("bin").alias("of"), powers.alias("c"))
    far = math.ceil(REACH / BIN) + 1
    near = bins.select(F.explode(F.sequence(F.col("of") - far, F.col("of") + far)).alias("bin"), F.struct("of", "c").alias("x"))
    near = near.join(moments.select("bin"), "bin", "left_semi").groupBy("bin").agg(F.collect_list("x").alias("near"))  # 2 far + 1 at most
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def part(x: Column) -> Column:
        def value(t: Column) -> Column:
            out = x["c"][TERMS - 1]
            for k in range(TERMS - 2, -1, -1):
                out = out * t + x["c"][k]
            return F.exp(-t * t) * out

        return let((F.col("label") - (x["of"] + 0.5) * width) / scale, value)

    dealt = counted.withColumn("_salt", F.pmod(F.xxhash64("label"), F.lit(salts)).cast("int")).join(near, ["bin", "_salt"])
    return dealt.select("label", F.aggregate("near", F.lit(0.0), lambda a, x: a + part(x)).alias("p"))


def density_weight(labels: DataFrame, bandwidth: float, alpha: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Weights that fall with the kernel density of the label, with mean 1 over distinct labels."""
    path = scratch(labels.sparkSession, "densities")
    kernel_sums(labels, bandwidth).write.parquet(path)
    density = labels.sparkSession.read.parquet(path)
    ends = density.agg(F.min("p").alias("low"), F.max("p").alias("high")).withColumn("_one", F.lit(1))
    scaled = density.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    raw = F.greatest(1 - alpha * F.coalesce(F.try_divide(F.col("p") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)), F.lit(eps))
    weighted = scaled.withColumn("w", raw)
    mean = weighted.agg(F.avg("w").alias("mean")).withColumn("_one", F.lit(1))
    return weighted.join(F.broadcast(mean), "_one").select("label", (F.col("w") / F.col("mean")).alias("weight"))


def moving_average(values: Column, k: int) -> Column:
    """Centred mean over k values, the ends repeated."""
    half = (k - 1) // 2

    def one(x: Column) -> Column:
        wide = F.concat(F.array_repeat(F.get(x, 0), half), x, F.array_repeat(F.element_at(x, -1), k - 1 - half))
        mean = lambda w: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.aggregate(F.slice(w, i, k), F.lit(0.0), lambda a, y: a + y) / k)
        return F.when(F.size(x) > 0, let(wide, mean)).otherwise(x)

    return let(values.cast("array<double>"), one)


def decompose(df: DataFrame, column: str, kernels: list[int]) -> DataFrame:
    """trend (mean over the kernels' moving averages) and residual."""
    parts = [moving_average(F.col(column), k) for k in kernels]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    out = df.withColumn("trend", F.transform(total, lambda x: x / len(kernels)))
    return out.withColumn("residual", F.zip_with(column, "trend", lambda x, y: x - y))


def patches(values: Column, length: int, stride: int) -> Column:
    """Windows of ``length`` every ``stride`` over the values with the last one repeated ``stride`` times."""

    def one(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - length) / stride).cast("int")), lambda i: F.slice(x, i * stride + 1, length))

    return let(F.concat(values, F.array_repeat(F.element_at(values, -1), stride)), one)


def series_normalise(df: DataFrame, column: str, subtract_last: bool = False, eps: float = 1e-5) -> DataFrame:
    """norm, centre and scale of each series, by population variance; denormalise is the exact way back."""
    x = F.col(column).cast("array<double>")
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
    out = df.withColumn("_mean", mean)
    var = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - F.col("_mean")) * (y - F.col("_mean"))) / n
    out = out.withColumn("centre", F.element_at(x, -1) if subtract_last else F.col("_mean")).withColumn("scale", F.sqrt(var + eps))
    return out.withColumn("norm", F.transform(x, lambda y: (y - F.col("centre")) / F.col("scale"))).drop("_mean")


def denormalise(df: DataFrame, column: str = "norm") -> DataFrame:
    return df.withColumn("restored", F.transform(column, lambda y: y * F.col("scale") + F.col("centre")))


#: Calendar features in [-0.5, 0.5] and the frequencies that use them (fixed values).
FEATURES = {
    "second": lambda t: F.second(t) / 59 - 0.5,
    "minute": lambda t: F.minute(t) / 59 - 0.5,
    "hour": lambda t: F.hour(t) / 23 - 0.5,
    "day_of_week": lambda t: F.weekday(t) / 6 - 0.5,
    "day_of_month": lambda t: (F.dayofmonth(t) - 1) / 30 - 0.5,
    "day_of_year": lambda t: (F.dayofyear(t) - 1) / 365 - 0.5,
    "month": lambda t: (F.month(t) - 1) / 11 - 0.5,
    "week": lambda t: (F.weekofyear(t) - 1) / 52 - 0.5,
}
BY_FREQUENCY = {
    "y": [], "m": ["month"], "w": ["day_of_month", "week"], "d": ["day_of_week", "day_of_month", "day_of_year"],
    "h": ["hour", "day_of_week", "day_of_month", "day_of_year"], "t": ["minute", "hour", "day_of_week", "day_of_month", "day_of_year"],
    "s": ["second", "minute", "hour", "day_of_week", "day_of_month", "day_of_year"],
}


def time_features(df: DataFrame, column: str, frequency: str) -> DataFrame:
    return df.withColumns({n: FEATURES[n](F.col(column)) for n in BY_FREQUENCY[frequency]})


PRIME = 2**31 - 1


def hash_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys (whole numbers) only, not on partitions.

    Squares modulo a prime, three to a key: any SQL engine gives the same numbers.
    """
    zero = F.lit(0).cast("long")
    parts = [x for k in keys for x in (F.pmod(k.cast("long"), F.lit(PRIME)), zero, zero)]
    step = lambda h, k: (h * 31 + k + 1) % PRIME
    return F.aggregate(F.array(*parts), F.lit(7).cast("long"), lambda h, k: (step(h, k) * step(h, k) + 374761393) % PRIME) / float(PRIME)


def hash_normal(*keys: Column) -> Column:
    u, v = hash_uniform(F.lit(1), *keys), hash_uniform(F.lit(2), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def augment_cutout_jitter(values: Column, key: Column, holes: int = 10, width: int = 5, sigma: float = 0.02, seed: int = 0) -> Column:
    """Inside random holes x becomes x + x * noise, the noise clipped at three sigma."""
    half = width // 2

    def one(x: Column) -> Column:
        n = F.size(x)
        centres = F.transform(F.sequence(F.lit(1), F.lit(holes)), lambda h: F.floor(hash_uniform(key, h, F.lit(seed)) * n).cast("int"))

        def changed(c: Column) -> Column:
            noise = lambda j: F.greatest(F.least(hash_normal(key, j, F.lit(seed + 1)) * sigma, F.lit(3 * sigma)), F.lit(-3 * sigma))
            return F.transform(x, lambda y, j: F.when(F.exists(c, lambda h: (j >= h - half) & (j < h + half)), y + y * noise(j)).otherwise(y))

        return let(centres, changed)

    return let(values.cast("array<double>"), one)


def _by_series(df: DataFrame, key: str, column: str, out: str, fn, other: str | None = None) -> DataFrame:
    """``fn(values, key[, values of the other column])`` per row, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            second = b[other] if other else [None] * len(b)
            yield b.assign(**{out: [fn(np.asarray(x, float), k, None if y is None else np.asarray(y, float)).tolist() for x, k, y in zip(b[column], b[key], second, strict=True)]})

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != out], f"`{out}` array<double>"])
    return df.mapInPandas(run, schema)


def _dropped(n: int, rate: float, key: int, seed: int) -> np.ndarray:
    return np.random.default_rng([abs(int(key)), seed]).random(n) < rate


def augment_freq_mask(df: DataFrame, key: str, column: str, rate: float = 0.25, seed: int = 0) -> DataFrame:
    """masked: the series without some of its frequencies.

    A bin goes with probability ``rate`` if its index in the order of amplitudes is over 5.
    """

    def fn(x, k, _):
        spectrum = np.fft.rfft(x)
        order = np.argsort(-np.abs(spectrum), kind="stable")
        spectrum[_dropped(len(spectrum), rate, k, seed) & (order > 5)] = 0
        return np.fft.irfft(spectrum, n=len(x))

    return _by_series(df, key, column, "masked", fn)


def augment_mix(df: DataFrame, key: str, first: str, second: str, p: float = 0.5, seed: int = 0) -> DataFrame:
    """mixed: one of two versions by a hash of the key."""
    return df.withColumn("mixed", F.when(hash_uniform(F.col(key), F.lit(seed)) < p, F.col(first)).otherwise(F.col(second)))


def augment_basic(values: Column, key: Column, kind: str, seed: int = 0) -> Column:
    """reverse; stretch (to double length, then the first half); noise within 0.05; half masked, at random or in one piece."""
    x = values.cast("array<double>")
    if kind == "reverse":
        return F.reverse(x)
    if kind == "stretch":
        return let(x, lambda y: F.transform(y, lambda _, j: F.get(y, F.floor(j / 2).cast("int"))))
    if kind == "noise":
        return F.transform(x, lambda y, j: y + 0.1 * hash_uniform(key, j, F.lit(seed)) - 0.05)
    if kind == "mask":
        return F.transform(x, lambda y, j: F.when(hash_uniform(key, j, F.lit(seed)) < 0.5, 0.0).otherwise(y))
    if kind == "mask_run":
        at = F.floor(hash_uniform(key, F.lit(seed)) * (F.size(x) - F.floor(F.size(x) / 2) + 1))
        return F.transform(x, lambda y, j: F.when((j >= at) & (j < at + F.floor(F.size(x) / 2)), 0.0).otherwise(y))
    raise ValueError(kind)


def augment_freq_mix(df: DataFrame, key: str, column: str, rate: float = 0.5, seed: int = 0) -> DataFrame:
    """freq_mixed: some frequencies of each series come from its successor in hash order.

    Series are dealt into buckets by hash and paired inside them, so that no window holds them all.
    """
    buckets = 64
    rows = df.withColumn("_o", F.xxhash64(key, F.lit(seed))).withColumn("_b", F.pmod("_o", F.lit(buckets)))
    w = Window.partitionBy("_b").orderBy("_o", key)
    other = F.coalesce(F.lead(column).over(w), F.first(column).over(w))

    def fn(x, k, y):
        a, b = np.fft.rfft(x), np.fft.rfft(np.resize(y, len(x)))
        swap = _dropped(len(a), rate, k, seed)
        a[swap] = b[swap]
        return np.fft.irfft(a, n=len(x))

    return _by_series(rows.withColumn("_other", other).drop("_o", "_b"), key, column, "freq_mixed", fn, "_other").drop("_other")


def augment_freq_dropout(df: DataFrame, key: str, column: str, rate: float = 0.5, seed: int = 0) -> DataFrame:
    def fn(x, k, _):
        a = np.fft.rfft(x)
        a[_dropped(len(a), rate, k, seed)] = 0
        return np.fft.irfft(a, n=len(x))

    return _by_series(df, key, column, "freq_dropped", fn)


def value_dropout(values: Column, key: Column, p: float, seed: int = 0) -> Column:
    """Values are zeroed with probability p, the others scaled by 1 / (1 - p)."""
    return F.transform(values.cast("array<double>"), lambda y, j: F.when(hash_uniform(key, j, F.lit(seed)) < p, 0.0).otherwise(y / (1 - p)))


def operating_note(cycles: DataFrame) -> DataFrame:
    """Text per cell: all cycles normal, or the lists of normal and test cycles."""
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("attribute") == k, F.col("cycle_number"))))
    rows = cycles.groupBy("cell_id").agg(pick("Cycling").alias("n"), pick("RPT").alias("r"))
    text = lambda c: F.concat_ws(", ", F.transform(c, lambda x: x.cast("string")))
    note = F.when(F.size("r") == 0, F.lit("All cycles are normal cycles.")).otherwise(F.format_string("Normal cycles: %s. Reference tests: %s.", text("n"), text("r")))
    return rows.select("cell_id", note.alias("note"))


def stride_downsample(readings: DataFrame, max_points: int) -> DataFrame:
    """Every k-th row of each cell by place, so that at most about ``max_points`` are left."""
    size = readings.groupBy("cell_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / max_points)).alias("_k"))
    rows = in_ranges(readings.withColumn("_one", F.lit(1)), ["cell_id", "cycle_number", "idx"])
    out = across(rows, ["cell_id"], totals={"_place": "_one"}, constants=size, spent=True)
    return out.where((F.col("_place") - 1) % F.col("_k") == 0).select(*readings.columns)

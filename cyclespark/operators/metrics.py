"""Evaluation metrics and baselines (survey group J)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.operators.curves import hash_uniform

Y, P = "y", "yhat"


def error_metrics(alphas: tuple[float, ...] = ()) -> dict[str, Column]:
    """MAE, MSE, RMSE, MAPE, MSPE and the alpha accuracies in %, as aggregates of y and yhat."""
    e, rel = F.col(P) - F.col(Y), F.abs(F.col(P) - F.col(Y)) / F.abs(F.nullif(F.col(Y), F.lit(0.0)))
    out = {"mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(rel), "mspe": F.avg(rel * rel)}
    for a in alphas:
        out[f"acc_{round(a * 100)}"] = 100 * F.avg((F.abs(e) / F.col(Y) <= a).cast("double"))
    return out


def _agg(grouped, alphas: tuple[float, ...] = ()) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in error_metrics(alphas).items()])


def regression_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    return _agg(preds.groupBy(*by))


def rse_corr(preds: DataFrame, group: str) -> DataFrame:
    """Root relative squared error, and the sum of dy dp over the root of the sum of dy2 dp2."""
    means = preds.groupBy(group).agg(F.avg(Y).alias("_y"), F.avg(P).alias("_p"))
    both = preds.join(means, group)
    dy, dp = F.col(Y) - F.col("_y"), F.col(P) - F.col("_p")
    e = F.col(Y) - F.col(P)
    return both.groupBy(group).agg((F.sqrt(F.sum(e * e)) / F.sqrt(F.sum(dy * dy))).alias("rse"), (F.sum(dy * dp) / F.sqrt(F.sum(dy * dy * dp * dp))).alias("corr"))


def alpha_accuracy(preds: DataFrame, by: list[str], alphas: tuple[float, ...] = (0.15, 0.10)) -> DataFrame:
    m = error_metrics(alphas)
    return preds.groupBy(*by).agg(*[m[f"acc_{round(a * 100)}"].alias(f"acc_{round(a * 100)}") for a in alphas])


def seen_unseen_metrics(preds: DataFrame, alphas: tuple[float, ...] = (0.15, 0.10)) -> DataFrame:
    """Metrics on all, on seen and on unseen rows; an empty group has no row."""
    part = F.when(F.grouping("seen") == 1, "all").when(F.col("seen"), "seen").otherwise("unseen")
    m = {k: c.alias(k) for k, c in error_metrics(alphas).items()}
    sets = preds.groupingSets([[], ["seen"]], "seen").agg(part.alias("part"), F.count(F.lit(1)).alias("n"), *m.values())
    return sets.drop("seen")


def metrics_by_seen_cycles(preds: DataFrame, alphas: tuple[float, ...] = (0.15, 0.10)) -> DataFrame:
    m = error_metrics(alphas)
    return preds.groupBy("n_seen").agg(m["mape"].alias("mape"), *[m[f"acc_{round(a * 100)}"].alias(f"acc_{round(a * 100)}") for a in alphas])


def mean_std_over_seeds(scores: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean and population deviation of a metric over the seeds."""
    return scores.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def best_epoch(log: DataFrame, run: str = "run", metric: str = "val_mape") -> DataFrame:
    """The first epoch of least validation metric, with its other metrics."""
    rest = [c for c in log.columns if c not in (run, "epoch", metric)]
    best = log.groupBy(run).agg(F.min_by(F.struct("epoch", metric, *rest), F.struct(metric, "epoch")).alias("b"))
    return best.select(run, "b.*")


def leaderboard(scores: DataFrame, metric: str, top: int = 3, digits: int = 3) -> DataFrame:
    """mean±std per model and dataset as text, with the rank of the model in the dataset up to ``top``."""
    cells = mean_std_over_seeds(scores, ["model", "dataset"], metric)
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy("mean", "model"))
    form = F.format_string(f"%.{digits}f±%.{digits}f", "mean", "std")
    return cells.withColumn("rank", rank).where(F.col("rank") <= top).select("dataset", "rank", "model", form.alias("text"))


def pivot_board(scores: DataFrame, metric: str, datasets: list[str]) -> DataFrame:
    return scores.groupBy("model").pivot("dataset", datasets).agg(F.avg(metric))


def mean_label_baseline(train: DataFrame, test: DataFrame, alphas: tuple[float, ...] = (0.15, 0.10), denominator: str = "reference") -> DataFrame:
    """Predict the dataset's train mean; errors in % of the label, or of the prediction."""
    mean = train.groupBy("dataset").agg(F.avg(Y).alias(P))
    both = test.drop(P).join(mean, "dataset")
    out = _agg(both.groupBy("dataset"))
    base = F.col(Y) if denominator == "reference" else F.col(P)
    hits = [(100 * F.avg((F.abs(F.col(P) - F.col(Y)) / base <= a).cast("double"))).alias(f"acc_{round(a * 100)}") for a in alphas]
    return out.join(both.groupBy("dataset").agg(*hits), "dataset")


def weighted_multioutput_metrics(rows: DataFrame, average: bool = False) -> DataFrame:
    """MAE, MSE, RMSE and MAPE by output, weighted by w; or their means over the outputs."""
    pairs = rows.select("w", F.posexplode(F.arrays_zip(F.col(Y), F.col(P))).alias("output", "x"))
    e, w = F.col("x.yhat") - F.col("x.y"), F.col("w")
    total = lambda c: F.sum(c * w) / F.sum(w)
    mape = F.abs(e) / F.greatest(F.abs("x.y"), F.lit(2.220446049250313e-16))
    out = pairs.groupBy("output").agg(total(F.abs(e)).alias("mae"), total(e * e).alias("mse"), F.sqrt(total(e * e)).alias("rmse"), total(mape).alias("mape"))
    return out.agg(*[F.avg(c).alias(c) for c in ("mae", "mse", "rmse", "mape")]) if average else out


def masked_losses(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAPE, sMAPE and MASE with a 0/1 mask and per-row scale; undefined terms count as 0."""
    e = F.abs(F.col(P) - F.col(Y))
    term = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)) * F.col("mask")
    return rows.groupBy(*by).agg(
        F.avg(term(e, F.abs(Y))).alias("mape"), (200 * F.avg(term(e, F.abs(Y) + F.abs(P)))).alias("smape"), F.avg(term(e, F.col("scale"))).alias("mase")
    )


def grouped_forecast_score(series: DataFrame, freq: dict[str, int]) -> DataFrame:
    """Per group: sMAPE, MAPE, MASE and OWA against the naive forecast, regrouped and rounded.

    ``series``: grp, series, idx, y, yhat. The scale is the mean seasonal difference of y; naive repeats
    the value of one season before. Groups that aren't yearly, quarterly or monthly are Others; Average
    weighs groups by their number of series.
    """
    table = F.create_map(*[F.lit(x) for kv in freq.items() for x in kv])
    rows = series.withColumn("_f", F.coalesce(table[F.col("grp")], F.lit(1)))
    parts = []
    for f in sorted({1, *freq.values()}):
        w = Window.partitionBy("grp", "series").orderBy("idx")
        parts.append(rows.where(F.col("_f") == f).withColumn("naive", F.lag(Y, f).over(w)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("naive is not null")
    smape = lambda p: 200 * F.avg(F.coalesce(F.try_divide(F.abs(F.col(p) - F.col(Y)), F.abs(Y) + F.abs(p)), F.lit(0.0)))
    one = rows.groupBy("grp", "series").agg(
        smape(P).alias("smape"), smape("naive").alias("smape_n"), (100 * F.avg(F.try_divide(F.abs(F.col(P) - F.col(Y)), F.abs(Y)))).alias("mape"),
        F.try_divide(F.avg(F.abs(F.col(P) - F.col(Y))), F.avg(F.abs(F.col("naive") - F.col(Y)))).alias("mase"),
    )
    known = F.when(F.col("grp").isin("Yearly", "Quarterly", "Monthly"), F.col("grp")).otherwise("Others")
    named = one.withColumn("grp", known)
    named = named.unionByName(named.withColumn("grp", F.lit("Average")))
    out = named.groupBy("grp").agg(F.avg("smape").alias("smape"), F.avg("smape_n").alias("_n"), F.avg("mape").alias("mape"), F.avg("mase").alias("mase"))
    owa = (F.try_divide(F.col("smape"), F.col("_n")) + F.col("mase")) / 2
    return out.select("grp", *[F.round(c, 3).alias(c) for c in ("smape", "mape", "mase")], F.round(owa, 3).alias("owa"))


def _blocks(n: int, most: int, tasks: int) -> int:
    """Blocks of at most about ``most`` of ``n`` rows; more, down to 2,048 rows, as long as there are fewer pairs of them than tasks."""
    return max(math.ceil(n / most), min(math.ceil(n / 2048), math.ceil(math.sqrt(2 * tasks))))


def mmd_rbf(pairs: DataFrame, vector: str, block_rows: int = 16_384, multiplier: float = 2.0, kernels: int = 5) -> DataFrame:
    """Two-sample statistic of all rows of side 0 and 1 (id, side, vector); rows without a vector don't count.

    The bandwidth is the mean squared distance, from sums by place in the vector. Then each block
    of about ``block_rows`` rows at most meets each other one once, so a task's size is bounded and the
    number of block pairs, and so what is shuffled, grows with the square of the table over that of a block. Blocks are
    smaller, from 2,048 rows on, where there would be fewer pairs than shuffle partitions. Sides of unlike number are weighed
    by their own numbers. An empty side gives null, rows that are all equal give NaN.
    """
    rows = pairs.where(F.col(vector).isNotNull()).select("id", "side", F.col(vector).cast("array<double>").alias("x"))
    number = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(number.values())
    if not (number.get(0) and number.get(1)):
        return pairs.sparkSession.range(1).select(F.lit(None).cast("double").alias("mmd"))
    places = rows.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    width = places.agg(F.sum(2 * (n * F.col("q") - F.col("s") * F.col("s")))).first()[0] / (float(n) * n - n)
    blocks = _blocks(n, block_rows, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("side", kind="stable")
        return pd.DataFrame({"b": [key[0]], "n0": [int((b["side"] == 0).sum())], "n": [len(b)], "x": [np.stack(b["x"].to_list()).tobytes()]})

    def signed(b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        share = np.full(b["n"], -1.0 / number[1])
        share[: b["n0"]] = 1.0 / number[0]
        return np.frombuffer(b["x"]).reshape(b["n"], -1), share

    def met(key: tuple, two: pd.DataFrame) -> pd.DataFrame:
        if key[0] != key[1] and len(two) == 1:  # the other block has no rows
            return pd.DataFrame({"part": [0.0]})
        (x, a), (y, c) = signed(two.iloc[0]), signed(two.iloc[-1])
        total, y2 = 0.0, (y * y).sum(1)
        with np.errstate(invalid="ignore", divide="ignore", under="ignore"):
            for at in range(0, len(x), 128):
                part = x[at : at + 128]
                d = np.maximum((part * part).sum(1)[:, None] + y2 - 2 * part @ y.T, 0)
                kernel = np.exp(d / (-width * multiplier ** (kernels - 1 - kernels // 2)))  # the widest
                summed = kernel.copy()
                for _ in range(kernels - 1):
                    kernel = kernel**multiplier
                    summed += kernel
                total += float(a[at : at + 128] @ summed @ c)
        return pd.DataFrame({"part": [total * (1 if key[0] == key[1] else 2)]})

    own = F.pmod(F.xxhash64("id", "side"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("_b", own).groupBy("_b").applyInPandas(packed, "b int, n0 long, n long, x binary")
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = other.withColumns({"p": F.least("b", "o"), "q": F.greatest("b", "o")})
    return both.groupBy("p", "q").applyInPandas(met, "part double").agg(F.sum("part").alias("mmd"))


def point_adjust(points: DataFrame) -> DataFrame:
    """adjusted: inside a true run with any hit all are hits; the very first place is never filled back."""
    w = Window.partitionBy("series").orderBy("idx")
    change = F.coalesce((F.col("truth") != F.lag("truth").over(w)).cast("int"), F.lit(1))
    runs = points.withColumn("_new", change).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_first", F.row_number().over(w) == 1)
    hit = F.max("pred").over(Window.partitionBy("series", "_run"))
    filled = F.when((F.col("truth") == 1) & ~F.col("_first"), hit).otherwise(F.col("pred"))
    return runs.withColumn("adjusted", filled).drop("_new", "_run", "_first")


def accuracy(points: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    return points.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def nucleus_filter(probs: DataFrame, p: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per group the most probable items up to mass p, renormalised, and one seeded draw.

    ``probs``: grp, item, prob. The draw depends on the seed and the group alone: a whole number as such, else its hash.
    """
    w = Window.partitionBy("grp").orderBy(F.desc("prob"), "item")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kept = probs.withColumn("_cum", F.sum("prob").over(upto)).where(F.col("_cum") - F.col("prob") <= p)
    kept = kept.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("grp"))).drop("_cum")
    number = F.col("grp") if dict(probs.dtypes)["grp"] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64("grp")
    draw = kept.withColumn("_cum", F.sum("prob").over(upto)).where(F.col("_cum") > hash_uniform(number, F.lit(seed)))
    return kept, draw.groupBy("grp").agg(F.min_by("item", "_cum").alias("item"))


def linear_life_model(train: DataFrame, features: list[str], label: str = "label", weight: str | None = None, ridge: float = 1e-6):
    """A fitted pipeline: assembled features, linear regression of ``label``, which the caller standardises."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(featuresCol="features", labelCol=label, predictionCol=P, regParam=ridge, solver="normal")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(train)


def batch_score(model, samples: DataFrame, ids: list[str], mean: str | None = None, std: str | None = None) -> DataFrame:
    """Predictions with ids, scaled back if mean and std columns are named."""
    scored = model.transform(samples)
    value = F.col(P) * F.col(std) + F.col(mean) if mean and std else F.col(P)
    return scored.select(*ids, value.alias(P))

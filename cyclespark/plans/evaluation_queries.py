"""Queries of the survey groups F to J: life, curves, cohorts, checks and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cyclespark.functions import parse
from cyclespark.functions.windows import in_cell
from cyclespark.operators import checks, cohort, curves, life, metrics, segment

from . import fixtures as fx
from .registry import query, rounded
from .telemetry_queries import CELL, CYC, KEY, LABEL, PHASES, scratch

# --- F: cycles, health and life -------------------------------------------------------------


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, max(qd) AS qd_max, max(qc) AS qc_max, min(v) AS v_min, max(v) AS v_max, round(avg(i), 9) AS i_mean, count(*) AS n_points, round(max(t) - min(t), 6) AS duration FROM readings GROUP BY 1, 2")
def f01_cycle_summary(spark, sf_dir):
    return rounded(life.cycle_summary(fx.readings(spark, sf_dir)), "i_mean", places=9).withColumn("duration", F.round("duration", 6))


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, round(coalesce(max(qd) FILTER (i < 0), max(qd)) / 1.1 / 0.8, 6) AS soh FROM readings GROUP BY 1, 2")
def f02_soh(spark, sf_dir):
    return rounded(life.soh(fx.readings(spark, sf_dir), F.lit(1.1), F.lit(0.8), "discharge"), "soh", places=6)


@query(f"WITH {fx.HEALTH}, {LABEL.format(end=0.8, k=20)} SELECT cell_id, round(last_soh, 6) AS last_soh, CAST(CASE WHEN last_soh >= 0.825 THEN NULL WHEN last_soh > 0.8 THEN trunc(line) ELSE first END AS INTEGER) AS eol FROM ends LEFT JOIN line USING (cell_id)")
def f03_life_label(spark, sf_dir):
    return rounded(life.life_label(fx.health(spark, sf_dir)), "last_soh", places=6)


@query(f"WITH {fx.HEALTH}, {LABEL.format(end=0.8, k=20)} SELECT cell_id, CAST(trunc(line) AS INTEGER) AS eol FROM line")
def f04_extrapolate_life(spark, sf_dir):
    return life.extrapolate_life(fx.health(spark, sf_dir))


@query(f"""WITH {fx.HEALTH}, h AS (SELECT cell_id, cycle_number, soh / first_value(soh) OVER w AS soh, row_number() OVER w AS pos FROM health WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
  k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number DESC) AS back FROM h WHERE NOT (cell_id % 5 = 0 AND pos = 9)),
  l AS (SELECT cell_id, regr_intercept(cycle_number, soh) + regr_slope(cycle_number, soh) * 0.9 AS line FROM k WHERE back <= 20 GROUP BY 1),
  e AS (SELECT cell_id, min(soh) AS low, min(pos) FILTER (soh <= 0.9) AS first FROM k GROUP BY 1)
  SELECT cell_id, round(low, 6) AS low, CAST(CASE WHEN low <= 0.9 THEN first WHEN low < 0.925 THEN trunc(line) END AS INTEGER) AS eol FROM e LEFT JOIN l USING (cell_id)""")
def f05_life_label_first_cycle_nominal(spark, sf_dir):
    k = F.col("s_suppkey")
    rules = fx.table(spark, sf_dir, "supplier").where(k % 5 == 0).select(k.alias(CELL), F.lit(9).alias("skip"))
    caps = fx.health(spark, sf_dir).withColumnRenamed("soh", "qd_max")
    return rounded(life.life_label_first_cycle_nominal(caps, rules), "low", places=6)


@query(f"""WITH {fx.HEALTH}, c AS (SELECT cell_id, cycle_number, CASE WHEN (cell_id + cycle_number) % 13 <> 0 THEN soh END AS q FROM health),
  b AS (SELECT cell_id, cycle_number, first_value(q IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM c),
  h AS (SELECT cell_id, cycle_number, q / first_value(q) OVER w AS soh, row_number() OVER w AS pos FROM b WHERE q IS NOT NULL WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
  s AS (SELECT *, min(pos) FILTER (cell_id % 2 = 1 AND soh <= 0.925) OVER (PARTITION BY cell_id) AS bend FROM h WHERE NOT (cell_id % 5 = 0 AND pos = 9)),
  k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number DESC) AS back FROM s WHERE bend IS NULL OR pos <= bend),
  l AS (SELECT cell_id, regr_intercept(cycle_number, soh) + regr_slope(cycle_number, soh) * 0.85 AS line FROM k WHERE back <= 20 GROUP BY 1),
  e AS (SELECT cell_id, min(soh) AS low, min(pos) FILTER (soh <= 0.85) AS first FROM s GROUP BY 1)
  SELECT cell_id, round(low, 6) AS low, CAST(CASE WHEN low <= 0.85 THEN first WHEN low < 0.925 THEN trunc(line) END AS INTEGER) AS eol FROM e LEFT JOIN l USING (cell_id)""")
def f05_life_label_early_window(spark, sf_dir):
    """Missing capacities are filled back; odd cells take the line before their capacity rises again."""
    k = F.col("s_suppkey")
    rules = fx.table(spark, sf_dir, "supplier").select(k.alias(CELL), F.when(k % 5 == 0, 9).alias("skip"), (k % 2 == 1).alias("early"))
    caps = fx.health(spark, sf_dir).withColumn("qd_max", F.when((F.col(CELL) + F.col(CYC)) % 13 != 0, F.col("soh"))).drop("soh")
    return rounded(life.life_label_first_cycle_nominal(caps, rules, end=0.85), "low", places=6)


CROSS = """c AS (SELECT *, lag(cycle_number) OVER w AS x0, lag(soh) OVER w AS y0, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number DESC) AS back FROM health WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
  x AS (SELECT *, CASE WHEN y0 > 0.8 AND soh <= 0.8 THEN CASE WHEN abs(soh - y0) < 1e-12 THEN cycle_number ELSE x0 + (0.8 - y0) * (cycle_number - x0) / (soh - y0) END END AS cr FROM c)"""


@query(f"""WITH {fx.HEALTH}, {CROSS}, {LABEL.format(end=0.8, k=20)}, g AS (SELECT cell_id, max(cr) AS cr, arg_min(soh, cycle_number) AS yf, min(cycle_number) AS xf, arg_max(soh, cycle_number) AS yl FROM x GROUP BY 1)
  SELECT cell_id, CAST(ceil(coalesce(cr, CASE WHEN yf <= 0.8 THEN xf END, CASE WHEN yl > 0.8 AND yl < 0.825 THEN line END)) AS INTEGER) AS eol FROM g LEFT JOIN line USING (cell_id)""")
def f06_life_last_crossing(spark, sf_dir):
    return life.life_last_crossing(fx.health(spark, sf_dir))


@query(f"""WITH {fx.HEALTH}, {CROSS}, g AS (SELECT cell_id, min(cr) AS cr, arg_min(soh, cycle_number) AS yf, min(cycle_number) AS xf FROM x GROUP BY 1),
  p AS (SELECT cell_id, x0, y0, cycle_number AS x1, soh AS y1, x0 + (0.8 - y0) * (cycle_number - x0) / nullif(soh - y0, 0) AS ln FROM x WHERE back = 1)
  SELECT cell_id, CAST(ceil(CASE WHEN yf <= 0.8 THEN xf ELSE coalesce(cr, CASE WHEN ln >= x1 THEN ln END) END) AS INTEGER) AS eol FROM g JOIN p USING (cell_id)""")
def f07_life_first_crossing(spark, sf_dir):
    return life.life_first_crossing(fx.health(spark, sf_dir))


@query(f"""WITH {fx.HEALTH}, b AS (SELECT cell_id, cycle_number AS rpt_order, cycle_number * 10 AS th, soh AS qd FROM health)
  SELECT cell_id, rpt_order, round((th - first_value(th) OVER w) / first_value(qd) OVER w, 4) AS efc, round(qd / first_value(qd) OVER w, 4) AS soh FROM b WINDOW w AS (PARTITION BY cell_id ORDER BY rpt_order)""")
def f08_efc_curve(spark, sf_dir):
    h = fx.health(spark, sf_dir).withColumnRenamed(CYC, "rpt_order")
    return rounded(life.efc_curve(h.select(CELL, "rpt_order", (F.col("rpt_order") * 10.0).alias("throughput")), h.select(CELL, "rpt_order", F.col("soh").alias("qd"))), "efc", "soh")


@query(f"WITH {fx.CELLS} SELECT cell_id, CAST(ceil(s_acctbal / 3) AS INTEGER) AS eol FROM cells JOIN supplier ON s_suppkey = num WHERE cell_id NOT LIKE 'CALB%' AND cell_id NOT LIKE 'MATR%'")
def f09_labels_from_table(spark, sf_dir):
    table = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_index"), (F.col("s_acctbal") / 3).alias("life"))
    named = fx.cells(spark, sf_dir).where(~F.col(CELL).startswith("CALB"))
    return life.labels_from_table(named.select(CELL), table)[0]


@query("SELECT o_orderkey, CASE WHEN e < 300 THEN 1 WHEN e < 1000 THEN 2 WHEN e < 2000 THEN 3 ELSE 4 END AS life_class FROM (SELECT o_orderkey, floor(o_totalprice / 200) AS e FROM orders)")
def f10_life_class(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", parse.life_class(F.floor(F.col("o_totalprice") / 200)).alias("life_class"))


@query(f"""WITH {fx.READINGS}, f AS (SELECT cell_id, 1 - least(max(qc) / 1.2, 1) AS s, 1 - CASE WHEN max(qd) / 1.1 > 1 THEN 0 ELSE max(qd) / 1.1 END AS e FROM readings WHERE cycle_number = 1 GROUP BY 1)
  SELECT cell_id, round(CASE WHEN s = 1 AND e = 1 THEN 0 ELSE s END, 4) AS soc_start, round(e, 4) AS soc_end FROM f""")
def f11_initial_soc_window(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumns({"qc": F.col("qc") / 1.2, "qd": F.col("qd") / 1.1})
    return rounded(life.initial_soc_window(r, 1.0), "soc_start", "soc_end")


@query("""SELECT p_partkey, n AS stages, round(r1, 3) AS rate1, round(e1, 3) AS end1 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS n,
  CASE WHEN p_partkey % 2 = 0 THEN p_size / 10 ELSE 1 END AS r1, CASE WHEN p_partkey % 2 = 0 THEN p_size + 20 ELSE CAST(0.2 AS DOUBLE) END AS e1 FROM part)""")
def f12_parse_charge_policy(spark, sf_dir):
    size = F.col("p_size")
    two = F.concat((size / 10).cast("string"), F.lit("C("), (size + 20).cast("string"), F.lit("%)-4.8C-newstructure"))
    p = fx.table(spark, sf_dir, "part").select("p_partkey", parse.charge_policy(F.when(F.col("p_partkey") % 2 == 0, two).otherwise("1-2-3")).alias("s"))
    return rounded(p.select("p_partkey", F.size("s").alias("stages"), F.get("s", 0)["rate"].alias("rate1"), F.get("s", 0)["end_soc"].alias("end1")), "rate1", "end1", places=3)


@query(f"WITH {fx.HEALTH} SELECT count(*) AS raw, count_if(soh < 0.8) AS removed, count_if(soh > 1.04) AS replaced, count(*) - count_if(soh < 0.8) AS final, round(100.0 * count_if(soh < 0.8) / count(*), 4) AS removed_pct, round(100.0 * count_if(soh > 1.04) / count(*), 4) AS replaced_pct FROM health")
def f13_cleaning_stats(spark, sf_dir):
    c = fx.health(spark, sf_dir).groupBy(CELL).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("soh") < 0.8).alias("removed"), F.count_if(F.col("soh") > 1.04).alias("replaced"))
    return rounded(life.cleaning_stats(c), "removed_pct", "replaced_pct")


@query(f"WITH {fx.CELLS} SELECT cathode AS chemistry, CAST(floor(eol / 100) * 100 AS BIGINT) AS bin, count(*) AS n FROM cells GROUP BY 1, 2")
def f14_battery_type_histogram(spark, sf_dir):
    return life.battery_type_histogram(fx.cells(spark, sf_dir).withColumnRenamed("cathode", "chemistry"))


@query(f"WITH {fx.HEALTH} SELECT cell_id, round(arg_min(soh, cycle_number), 6) AS y0, min(cycle_number) AS first, max(cycle_number) AS last, count(*) AS n FROM health GROUP BY 1 HAVING arg_max(soh, cycle_number) >= 0.78")
def f15_soh_trajectories(spark, sf_dir):
    s = life.soh_trajectories(fx.health(spark, sf_dir))
    whole = s.groupBy(CELL, "first", "last").agg(F.min_by(F.get("curve", 0), "chunk").alias("y0"), F.sum(F.size("curve")).alias("n"))
    return rounded(whole, "y0", places=6)


# --- G: curves, samples, augmentation --------------------------------------------------------------


def _first3(df, column="y"):
    """The id, length, sum and first values of a curve, rounded."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("id", F.size(column).alias("n"), total.alias("total"), F.get(column, 1).alias("second")), "total", "second")


@query(f"""WITH {fx.SERIES}, p AS (SELECT id, x, unnest(range(20)) AS j FROM series), q AS (SELECT id, j, x, len(x) AS n, 1 + j * len(x) / CAST(19 AS DOUBLE) AS pos FROM p),
  y AS (SELECT id, j, CASE WHEN pos >= n THEN x[n] ELSE x[CAST(floor(pos) AS INTEGER)] + (x[CAST(floor(pos) AS INTEGER) + 1] - x[CAST(floor(pos) AS INTEGER)]) * (pos - floor(pos)) END AS y FROM q)
  SELECT id, CAST(count(*) AS INTEGER) AS n, round(sum(y), 4) AS total, round(max(y) FILTER (j = 1), 4) AS second FROM y GROUP BY 1""")
def g01_resample_curve(spark, sf_dir):
    return _first3(fx.series(spark, sf_dir).select("id", curves.resample_curve(F.col("x"), 20).alias("y")))


@query()
def g02_cycle_curves(spark, sf_dir):
    return curves.cycle_curves(segment.phase_slices(fx.readings(spark, sf_dir), 1.0), 1.1, 20)


@query(f"""WITH {fx.READINGS}, n AS (SELECT DISTINCT cell_id, cycle_number FROM readings WHERE i > 0.5), c AS (SELECT DISTINCT cell_id FROM n), a AS (SELECT cell_id, CAST(unnest(range(1, 9)) AS INTEGER) AS cycle_number FROM c)
  SELECT a.cell_id, a.cycle_number, CASE WHEN n.cell_id IS NULL THEN 0 ELSE 4 END AS total FROM a LEFT JOIN n ON n.cell_id = a.cell_id AND n.cycle_number = a.cycle_number""")
def g03_pad_missing_cycles(spark, sf_dir):
    c = fx.readings(spark, sf_dir).where("i > 0.5").select(CELL, CYC).distinct().withColumn("v", F.array_repeat(F.lit(1.0), 4))
    p = curves.pad_missing_cycles(c, 8, 4, ["v"])
    return p.select(CELL, CYC, F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("int").alias("total"))


@query(f"WITH {fx.CELLS}, e AS (SELECT cell_id, eol, eol % 50 AS valid, CAST(unnest(range(3, 31)) AS INTEGER) AS n_seen FROM cells WHERE eol > 30) SELECT cell_id, n_seen, eol AS label FROM e WHERE n_seen < eol AND n_seen <= valid AND n_seen >= 5")
def g04_expand_samples(spark, sf_dir):
    return curves.expand_samples(fx.cells(spark, sf_dir).withColumn("valid_cycles", F.col("eol") % 50), 3, 30, low=5)


@query(f"WITH {fx.HEALTH}, s AS (SELECT cell_id, CAST(unnest([5, 20]) AS INTEGER) AS n_seen FROM (SELECT DISTINCT cell_id FROM health)) SELECT s.cell_id, n_seen, cycle_number, round(CASE WHEN cycle_number <= n_seen THEN soh ELSE 0 END, 6) AS y FROM s JOIN health h ON s.cell_id = h.cell_id")
def g05_apply_prefix_mask(spark, sf_dir):
    h = fx.health(spark, sf_dir).select(CELL, CYC, F.array("soh").alias("v"))
    s = h.select(CELL).distinct().withColumn("n_seen", F.explode(F.array(F.lit(5), F.lit(20))))
    return rounded(curves.apply_prefix_mask(s, h, ["v"]).select(CELL, "n_seen", CYC, F.get("v", 0).alias("y")), "y", places=6)


@query(f"WITH {fx.HEALTH}, s AS (SELECT cell_id, CAST(unnest([5, 20]) AS INTEGER) AS n_seen FROM (SELECT DISTINCT cell_id FROM health)) SELECT s.cell_id, n_seen, cycle_number, round(CASE WHEN cycle_number <= n_seen THEN soh ELSE 0 END, 6) AS y FROM s JOIN health h ON s.cell_id = h.cell_id")
def g05_apply_prefix_mask_all(spark, sf_dir):
    """The mask over all cycles of the table."""
    h = fx.health(spark, sf_dir).select(CELL, CYC, F.array("soh").alias("v"))
    s = h.select(CELL).distinct().withColumn("n_seen", F.explode(F.array(F.lit(5), F.lit(20))))
    return rounded(curves.apply_prefix_mask(s, h, ["v"]).select(CELL, "n_seen", CYC, F.get("v", 0).alias("y")), "y", places=6)


@query(f"WITH {fx.HEALTH} SELECT cell_id, 2 * count(*) AS n, round(sum(soh * 3), 4) AS total FROM health GROUP BY 1")
def g06_flatten_features(spark, sf_dir):
    h = fx.health(spark, sf_dir).select(CELL, CYC, F.array("soh").alias("v"), F.array(F.col("soh") * 2).alias("q"))
    f = curves.flatten_features(h, ["v", "q"])
    return rounded(f.select(CELL, F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query(f"WITH {fx.HEALTH} SELECT DISTINCT cell_id FROM health WHERE (cell_id * 3 + cycle_number) % 97 = 0")
def g07_nan_guard(spark, sf_dir):
    bad = F.when((F.col(CELL) * 3 + F.col(CYC)) % 97 == 0, float("nan")).otherwise(F.col("soh"))
    return curves.nan_guard(fx.health(spark, sf_dir).select(CELL, F.array(bad).alias("v")), ["v"])


@query(f"WITH {fx.SERIES}, p AS (SELECT id, x[CAST(floor(unnest(range(10)) * len(x) / 10) AS INTEGER) + 1] AS y, unnest(range(10)) AS j FROM series) SELECT id, CAST(count(*) AS INTEGER) AS n, round(sum(y), 4) AS total, round(max(y) FILTER (j = 1), 4) AS second FROM p GROUP BY 1")
def g08_evenly_spaced(spark, sf_dir):
    return _first3(fx.series(spark, sf_dir).select("id", curves.evenly_spaced(F.col("x"), 10).alias("y")))


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, round(t - first_value(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx), 4) AS t FROM readings WHERE cycle_number IN (2, 5)")
def g09_relative_cycle_time(spark, sf_dir):
    return rounded(curves.relative_cycle_time(fx.readings(spark, sf_dir), [2, 5]).select(*KEY, "t"), "t")


@query(f"WITH {fx.CELLS}, m AS (SELECT avg(eol) AS mu, stddev_pop(eol) AS sd FROM cells WHERE num % 5 < 3) SELECT cell_id, round((eol - mu) / sd, 4) AS label_z FROM cells, m")
def g10_standardise_labels(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumnRenamed("eol", "label")
    return rounded(curves.standardise_labels(c, c.where("num % 5 < 3")).select(CELL, "label_z"), "label_z")


@query(f"WITH {fx.CELLS}, n AS (SELECT dataset, count(*) AS n FROM cells GROUP BY 1) SELECT cell_id, round(1 / ln(n / (SELECT min(n) FROM n) + 1), 4) AS weight FROM cells JOIN n USING (dataset)")
def g11_inverse_frequency_weight(spark, sf_dir):
    return rounded(curves.inverse_frequency_weight(fx.cells(spark, sf_dir), smooth=True).select(CELL, "weight"), "weight")


@query(f"""WITH {fx.CELLS}, k AS (SELECT eol AS label, count(*) AS n FROM cells GROUP BY 1),
  p AS (SELECT a.label, sum(CASE WHEN abs((a.label - b.label) / 100) <= 6 THEN b.n * exp(-((a.label - b.label) / 100) * ((a.label - b.label) / 100) / 2) ELSE 0 END) AS p FROM k a, k b GROUP BY 1),
  w AS (SELECT label, greatest(1 - coalesce((p - (SELECT min(p) FROM p)) / nullif((SELECT max(p) FROM p) - (SELECT min(p) FROM p), 0), 0), 1e-6) AS w FROM p) SELECT label, round(w / (SELECT avg(w) FROM w), 4) AS weight FROM w""")
def g12_density_weight(spark, sf_dir):
    return rounded(curves.density_weight(fx.cells(spark, sf_dir).select(F.col("eol").alias("label")), 100.0), "weight")


@query(f"""WITH {fx.SERIES}, w AS (SELECT id, x, list_concat([x[1], x[1]], x, [x[len(x)], x[len(x)]]) AS e FROM series), p AS (SELECT id, unnest(range(len(x))) AS j, e FROM w), y AS (SELECT id, j, list_avg(e[j + 1:j + 5]) AS y FROM p)
  SELECT id, CAST(count(*) AS INTEGER) AS n, round(sum(y), 4) AS total, round(max(y) FILTER (j = 1), 4) AS second FROM y GROUP BY 1""")
def g13_moving_average(spark, sf_dir):
    d = curves.decompose(fx.series(spark, sf_dir).select("id", "x"), "x", [5])
    return _first3(d, "trend")


@query(f"""WITH {fx.SERIES}, e AS (SELECT id, list_concat(x, list_transform(range(8), lambda k: x[len(x)])) AS e FROM series), p AS (SELECT id, e, unnest(range(CAST(floor((len(e) - 16) / 8) AS BIGINT) + 1)) AS j FROM e)
  SELECT id, CAST(count(*) AS INTEGER) AS n, round(sum(list_sum(e[j * 8 + 1:j * 8 + 16])), 4) AS total FROM p GROUP BY 1""")
def g14_patches(spark, sf_dir):
    p = fx.series(spark, sf_dir).select("id", curves.patches(F.col("x"), 16, 8).alias("p"))
    total = F.aggregate(F.flatten("p"), F.lit(0.0), lambda a, x: a + x)
    return rounded(p.select("id", F.size("p").alias("n"), total.alias("total")), "total")


@query(f"WITH {fx.SERIES} SELECT id, round(list_avg(x), 4) AS centre, round(sqrt(list_var_pop(x) + 1e-5), 4) AS scale, round(x[2], 4) AS second FROM series")
def g15_series_normalise(spark, sf_dir):
    n = curves.denormalise(curves.series_normalise(fx.series(spark, sf_dir), "x"))
    return rounded(n.select("id", "centre", "scale", F.get("restored", 1).alias("second")), "centre", "scale", "second")


@query("""SELECT event_id, round(minute(ts) / 59 - 0.5, 4) AS minute, round(hour(ts) / 23 - 0.5, 4) AS hour, round((isodow(ts) - 1) / 6 - 0.5, 4) AS day_of_week,
  round((day(ts) - 1) / 30 - 0.5, 4) AS day_of_month, round((dayofyear(ts) - 1) / 365 - 0.5, 4) AS day_of_year FROM events""")
def g16_time_features(spark, sf_dir):
    e = curves.time_features(fx.table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "t").drop("ts")
    return rounded(e, *[c for c in e.columns if c != "event_id"])


def uniform_sql(*keys: str) -> str:
    """The numbers of ``curves.hash_uniform`` in SQL."""
    parts = ", ".join(f"CAST({k} AS BIGINT) % 2147483647, 0, 0" for k in keys)
    step = "((h * 31 + k + 1) % 2147483647)"
    return f"(list_reduce([CAST(7 AS BIGINT), {parts}], lambda h, k: ({step} * {step} + 374761393) % 2147483647) / CAST(2147483647 AS DOUBLE))"


def normal_sql(*keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql('1', *keys)})) * cos(2 * pi() * {uniform_sql('2', *keys)}))"


def _round_each(df, *columns, places=6):
    return df.withColumns({c: F.transform(c, lambda y: F.round(y, places) + 0.0) for c in columns})


#: One row a value: id, j (place from 0), y, n; and the jittered value.
VALUES = fx.SERIES + ", v AS (SELECT id, x, len(x) AS n, unnest(range(len(x))) AS j, unnest(x) AS y FROM series)"
JITTERED = f"""{VALUES}, h AS (SELECT DISTINCT id, list_transform(range(1, 11), lambda c: CAST(floor({uniform_sql('id', 'c', '0')} * n) AS INTEGER)) AS holes FROM v),
  jittered AS (SELECT v.id, j, y, CASE WHEN len(list_filter(holes, lambda c: j >= c - 2 AND j < c + 2)) > 0 THEN y + y * greatest(least({normal_sql('v.id', 'j', '1')} * 0.02, 0.06), -0.06) ELSE y END AS z FROM v JOIN h ON h.id = v.id)"""
RUN = f"CAST(floor({uniform_sql('id', '0')} * (n - n // 2 + 1)) AS INTEGER)"


@query(f"WITH {JITTERED} SELECT id, list(round(z, 6) + 0 ORDER BY j) AS y FROM jittered GROUP BY id")
def g17_augment_cutout_jitter(spark, sf_dir):
    return _round_each(fx.series(spark, sf_dir).select("id", curves.augment_cutout_jitter(F.col("x"), F.col("id")).alias("y")), "y")


@query()
def g18_augment_freq_mask(spark, sf_dir):
    return curves.augment_freq_mask(fx.series(spark, sf_dir).select("id", "x"), "id", "x")


@query(f"WITH {JITTERED} SELECT id, list(round(CASE WHEN {uniform_sql('id', '0')} < 0.5 THEN y ELSE z END, 6) + 0 ORDER BY j) AS mixed FROM jittered GROUP BY id")
def g19_augment_mix(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumn("y", curves.augment_cutout_jitter(F.col("x"), F.col("id")))
    return _round_each(curves.augment_mix(s, "id", "x", "y").select("id", "mixed"), "mixed")


@query(f"WITH {fx.SERIES} SELECT id, CAST(len(x) AS INTEGER) AS n, round(list_sum(x), 4) AS total, round(x[len(x) - 1], 4) AS second FROM series")
def g20_augment_reverse(spark, sf_dir):
    return _first3(fx.series(spark, sf_dir).select("id", curves.augment_basic(F.col("x"), F.col("id"), "reverse").alias("y")))


@query(f"""WITH {VALUES}, b AS (SELECT id, j, x[j // 2 + 1] AS stretch, y + 0.1 * {uniform_sql('id', 'j', '0')} - 0.05 AS noise, CASE WHEN {uniform_sql('id', 'j', '0')} < 0.5 THEN 0 ELSE y END AS mask,
    CASE WHEN j >= {RUN} AND j < {RUN} + n // 2 THEN 0 ELSE y END AS mask_run FROM v)
  SELECT id, list(round(stretch, 6) + 0 ORDER BY j) AS stretch, list(round(noise, 6) + 0 ORDER BY j) AS noise, list(round(mask, 6) + 0 ORDER BY j) AS mask, list(round(mask_run, 6) + 0 ORDER BY j) AS mask_run FROM b GROUP BY id""")
def g20_augment_basic(spark, sf_dir):
    s = fx.series(spark, sf_dir)
    kinds = ("stretch", "noise", "mask", "mask_run")
    return _round_each(s.select("id", *[curves.augment_basic(F.col("x"), F.col("id"), k).alias(k) for k in kinds]), *kinds)


@query()
def g21_augment_freq_mix(spark, sf_dir):
    return curves.augment_freq_dropout(curves.augment_freq_mix(fx.series(spark, sf_dir).select("id", "x"), "id", "x"), "id", "x")


@query(f"WITH {VALUES} SELECT id, list(round(CASE WHEN {uniform_sql('id', 'j', '0')} < 0.3 THEN 0 ELSE y / 0.7 END, 6) + 0 ORDER BY j) AS y FROM v GROUP BY id")
def g22_value_dropout(spark, sf_dir):
    return _round_each(fx.series(spark, sf_dir).select("id", curves.value_dropout(F.col("x"), F.col("id"), 0.3).alias("y")), "y")


@query(f"""WITH {fx.HEALTH}, a AS (SELECT cell_id, string_agg(CAST(cycle_number AS VARCHAR), ', ' ORDER BY cycle_number) FILTER (cycle_number % 10 <> 0) AS n, string_agg(CAST(cycle_number AS VARCHAR), ', ' ORDER BY cycle_number) FILTER (cycle_number % 10 = 0) AS r FROM health GROUP BY 1)
  SELECT cell_id, CASE WHEN r IS NULL THEN 'All cycles are normal cycles.' ELSE 'Normal cycles: ' || n || '. Reference tests: ' || r || '.' END AS note FROM a""")
def g23_operating_note(spark, sf_dir):
    h = fx.health(spark, sf_dir)
    return curves.operating_note(h.withColumn("attribute", F.when(F.col(CYC) % 10 == 0, "RPT").otherwise("Cycling")))


@query(f"""WITH {fx.HEALTH}, a AS (SELECT cell_id, cell_id % 2 = 1 AND cycle_number % 10 = 0 AS test, cycle_number FROM health),
  b AS (SELECT cell_id, string_agg(CAST(cycle_number AS VARCHAR), ', ' ORDER BY cycle_number) FILTER (NOT test) AS n, string_agg(CAST(cycle_number AS VARCHAR), ', ' ORDER BY cycle_number) FILTER (test) AS r FROM a GROUP BY 1)
  SELECT cell_id, CASE WHEN r IS NULL THEN 'All cycles are normal cycles.' ELSE 'Normal cycles: ' || coalesce(n, '') || '. Reference tests: ' || r || '.' END AS note FROM b""")
def g23_operating_note_all(spark, sf_dir):
    """Notes of all cycles of the table; cells of even number have no tests."""
    test = (F.col(CELL) % 2 == 1) & (F.col(CYC) % 10 == 0)
    return curves.operating_note(fx.health(spark, sf_dir).withColumn("attribute", F.when(test, "RPT").otherwise("Cycling")))


@query(f"WITH {fx.READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) - 1 AS p, greatest(1, ceil(count(*) OVER (PARTITION BY cell_id) / 20)) AS k FROM readings) SELECT cell_id, cycle_number, idx FROM p WHERE p % k = 0")
def g24_stride_downsample(spark, sf_dir):
    return curves.stride_downsample(fx.readings(spark, sf_dir), 20).select(*KEY)


# --- H: cohorts ----------------------------------------------------------------------------------


@query(f"WITH {fx.SPLITS} SELECT cell_id FROM splits WHERE dataset = 'ASIA' AND split = 'train'")
def h01_assign_split(spark, sf_dir):
    return cohort.assign_split(fx.cells(spark, sf_dir), fx.splits(spark, sf_dir), "ASIA", 2021, "train").select(CELL)


@query(f"WITH {fx.SPLITS} SELECT DISTINCT 'MIX' AS dataset, split, cell_id FROM splits WHERE dataset IN ('ASIA', 'EUROPE')")
def h02_mix_splits(spark, sf_dir):
    return cohort.mix_splits(fx.splits(spark, sf_dir), ["ASIA", "EUROPE"], "MIX").select("dataset", "split", CELL)


@query("SELECT split, n FROM (SELECT 'train' AS split, CAST(floor(count(*) * 0.6) AS BIGINT) AS n FROM customer UNION ALL SELECT 'test', CAST(floor(count(*) * 0.2) AS BIGINT) FROM customer UNION ALL SELECT 'val', CAST(count(*) - floor(count(*) * 0.6) - floor(count(*) * 0.2) AS BIGINT) FROM customer)")
def h03_random_split(spark, sf_dir):
    s = cohort.random_split(fx.table(spark, sf_dir, "customer"), "c_custkey")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.CELLS} SELECT cell_id, eol FROM cells WHERE num % 3 <> 0")
def h04_attach_labels(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    labels = c.select(CELL, F.when(F.col("num") % 3 != 0, F.col("eol")).alias("eol"))
    return cohort.attach_labels(c.select(CELL), labels)


@query(f"WITH {fx.CELLS} SELECT cell_id, CASE WHEN num % 3 = 0 THEN 'b' ELSE 'a' END AS origin FROM cells")
def h05_merge_sources(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select(CELL, "num")
    return cohort.merge_sources(c.where("num % 3 <> 0").withColumn("origin", F.lit("a")), c.withColumn("origin", F.lit("b"))).select(CELL, "origin")


@query(f"""WITH {fx.CELLS} SELECT cell_id, CAST(CASE WHEN cell_id LIKE 'ZN-coin%' THEN 628 + row_number() OVER (PARTITION BY cell_id LIKE 'ZN-coin%' ORDER BY cell_id) WHEN cell_id LIKE 'SNL%' AND cell_id LIKE '%LFP%' THEN 1
  WHEN cell_id LIKE 'SNL%' AND cell_id LIKE '%_25C_%' THEN 2 WHEN cell_id LIKE 'SNL%' THEN 3 WHEN cell_id LIKE 'MATR%' THEN 4 END AS BIGINT) AS condition FROM cells""")
def h06_ageing_condition(spark, sf_dir):
    rules = spark.createDataFrame([(1, "SNL", "LFP", 1), (2, "SNL", "_25C_", 2), (3, "SNL", "", 3), (4, "MATR", "", 4)], "ord int, prefix string, pattern string, id int")
    return cohort.ageing_condition(fx.cells(spark, sf_dir).select(CELL), rules).select(CELL, "condition")


#: One rule of each shape: one substring; several that must all occur; alternatives; alternatives beside others; exclusions; the rest of a prefix.
SHAPES = [
    (10, "SNL", [["LFP"], ["_25C_", "_35C_"], ["0-100"]], [], 101),
    (20, "SNL", [["LFP"]], ["_15C_"], 102),
    (30, "SNL", [["NCA_15", "NCA_25"], ["-1C_", "-3C_"]], None, 103),
    (40, "SNL", [["NMC"], ["20-80"]], ["_25C_", "-1C_"], 104),
    (50, "SNL", [["NMC"]], None, 105),
    (60, "SNL", None, None, 106),
    (70, "CALB_15", [["_B1", "_B2"]], None, 107),
    (80, "CALB_15", [], ["_B7"], 108),
    (85, "CALB_35", None, None, 111),
    (90, "MATR", [["b1c1", "b1c2", "b1c4"]], ["9"], 109),
    (95, "MATR", None, None, 110),
]


def _has(part: str) -> str:
    return f"contains(cell_id, '{part}')"


def _rule_sql(rule) -> str:
    _, prefix, clauses, excluded, number = rule
    terms = [f"starts_with(cell_id, '{prefix}')", *(f"({' OR '.join(map(_has, c))})" for c in clauses or []), *(f"NOT {_has(x)}" for x in excluded or [])]
    return f"WHEN {' AND '.join(terms)} THEN {number}"


@query(f"""WITH {fx.CELLS}, own AS (SELECT cell_id, 628 + row_number() OVER (ORDER BY cell_id) AS id FROM cells WHERE cell_id LIKE 'ZN-coin%')
  SELECT cell_id, CAST(coalesce(id, CASE {' '.join(map(_rule_sql, SHAPES))} END) AS BIGINT) AS condition FROM cells LEFT JOIN own USING (cell_id)""")
def h06_ageing_rules(spark, sf_dir):
    """Rules of several substrings, alternatives and exclusions, as rows."""
    rules = spark.createDataFrame(SHAPES, "ord int, prefix string, clauses array<array<string>>, excluded array<string>, id int")
    return cohort.ageing_condition(fx.cells(spark, sf_dir).select(CELL), rules).select(CELL, "condition")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_size) AS INTEGER) AS dense FROM part")
def h07_dense_relabel(spark, sf_dir):
    return cohort.dense_relabel(fx.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "dense")


SEEN = "marks AS (SELECT s.dataset, s.cell_id, c.condition, EXISTS (SELECT 1 FROM splits t JOIN cells d ON d.cell_id = t.cell_id WHERE t.split <> 'test' AND t.dataset = s.dataset AND d.condition = c.condition) AS seen FROM splits s JOIN cells c ON c.cell_id = s.cell_id WHERE s.split = 'test')"


def _marks(spark, sf_dir):
    return cohort.seen_unseen(fx.cells(spark, sf_dir).select(CELL, "condition"), fx.splits(spark, sf_dir))


@query(f"WITH {fx.SPLITS}, {SEEN} SELECT dataset, cell_id, condition, seen FROM marks")
def h08_seen_unseen(spark, sf_dir):
    return _marks(spark, sf_dir)


@query(f"WITH {fx.SPLITS}, {SEEN} SELECT c.dataset, count(DISTINCT c.cell_id) AS cells, count(DISTINCT c.condition) AS conditions, coalesce(count_if(seen), 0) AS seen, coalesce(count_if(NOT seen), 0) AS unseen FROM cells c LEFT JOIN marks m ON m.cell_id = c.cell_id WHERE eol > 100 GROUP BY 1")
def h09_dataset_overview(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return cohort.dataset_overview(c.select(CELL, "eol"), c.select(CELL, "dataset", "condition"), _marks(spark, sf_dir))


@query("SELECT count(*) AS n, true AS known FROM customer")
def h10_resample_to_size(spark, sf_dir):
    c, s = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "supplier")
    drawn = cohort.resample_to_size(s, c, "s_suppkey")
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("s_suppkey").isNotNull()).alias("known"))


@query(f"WITH {fx.CELLS} SELECT cathode, anode, electrolyte, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM cells GROUP BY 1, 2, 3")
def h11_chemical_systems(spark, sf_dir):
    return cohort.chemical_systems(fx.cells(spark, sf_dir)).withColumn("datasets", F.array_join("datasets", ","))


@query(f"WITH {fx.CELLS}, u AS (SELECT 'anode' AS factor, anode AS value, dataset FROM cells UNION ALL SELECT 'cathode', cathode, dataset FROM cells) SELECT factor, value, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM u GROUP BY 1, 2")
def h12_factor_tables(spark, sf_dir):
    return cohort.factor_tables(fx.cells(spark, sf_dir).select("dataset", "anode", "cathode"), ["anode", "cathode"]).withColumn("datasets", F.array_join("datasets", ","))


@query(f"""WITH {fx.SPLITS}, s AS (SELECT * FROM splits UNION ALL SELECT dataset, seed, 'test', cell_id FROM splits WHERE split = 'val' AND length(cell_id) % 2 = 0)
  SELECT dataset, cell_id, 'two_splits' AS problem FROM s GROUP BY 1, 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT dataset, cell_id, 'no_label' FROM cells WHERE num % 6 = 0""")
def h13_split_integrity(spark, sf_dir):
    s, c = fx.splits(spark, sf_dir), fx.cells(spark, sf_dir)
    twice = s.unionByName(s.where((F.col("split") == "val") & (F.length(CELL) % 2 == 0)).withColumn("split", F.lit("test")))
    labels = c.select(CELL, F.when(F.col("num") % 6 != 0, F.lit(1)).alias("eol"))
    return cohort.split_integrity(twice, labels, c.select(CELL, "condition")).drop("seed")


@query(f"WITH {fx.CELLS} SELECT cell_id FROM cells WHERE cell_id NOT LIKE '%ZN%' AND cell_id NOT LIKE '%CALB%'")
def h14_filter_eval_domain(spark, sf_dir):
    files = fx.cells(spark, sf_dir).select(F.col(CELL).alias("file"))
    return cohort.filter_eval_domain(files, "MIX_large", {"MIX_large": ["ZN", "CALB", "NA-ion"]}).withColumnRenamed("file", CELL)


# --- I: quality checks ------------------------------------------------------------------------------

VALUES = f"{PHASES}, vals AS (SELECT 'd' || (cycle_number % 3) AS dataset, cell_id, cycle_number, phase, idx, CASE WHEN phase = 'charge' THEN qc ELSE qd END AS value FROM ph)"
VIOL = f"{VALUES}, viol AS (SELECT * FROM (SELECT *, lead(idx) OVER w AS next_idx, lead(value) OVER w - value AS diff FROM vals WINDOW w AS (PARTITION BY cell_id, cycle_number, phase ORDER BY idx)) WHERE diff < -1e-6)"
MARKS = f"{VIOL}, marks AS (SELECT dataset, cell_id, cycle_number, phase, count(*) AS count, min(diff) AS worst, arg_min(next_idx - idx, idx) = 1 AS continuous FROM viol GROUP BY 1, 2, 3, 4), cyc AS (SELECT DISTINCT 'd' || (cycle_number % 3) AS dataset, cell_id, cycle_number FROM readings)"


def _violations(spark, sf_dir):
    p = segment.phase_slices(fx.readings(spark, sf_dir), 1.0)
    value = F.when(F.col("phase") == "charge", F.col("qc")).otherwise(F.col("qd"))
    return checks.monotonicity_violations(p.select(_dataset(), CELL, CYC, "phase", "idx", value.alias("value")))


def _dataset():
    return F.concat(F.lit("d"), (F.col(CYC) % 3).cast("string")).alias("dataset")


def _cycles(spark, sf_dir):
    return fx.readings(spark, sf_dir).select(_dataset(), CELL, CYC).distinct()


def _found(spark, sf_dir):
    return checks.violation_continuity(_violations(spark, sf_dir))


@query(f"WITH {fx.READINGS}, {VIOL} SELECT cell_id, cycle_number, phase, idx, round(diff, 6) AS diff FROM viol")
def i01_monotonicity_violations(spark, sf_dir):
    return rounded(_violations(spark, sf_dir).select(CELL, CYC, "phase", "idx", "diff"), "diff", places=6)


@query(f"WITH {fx.READINGS}, {MARKS} SELECT dataset, cell_id, cycle_number, phase, count, round(worst, 6) AS worst, continuous FROM marks")
def i02_violation_continuity(spark, sf_dir):
    return rounded(_found(spark, sf_dir), "worst", places=6)


@query(f"""WITH {fx.READINGS}, {MARKS}, a AS (SELECT dataset, count(DISTINCT cell_id) AS cells, count(*) AS cycles FROM cyc GROUP BY 1), b AS (SELECT dataset, count(DISTINCT cell_id) AS bad_cells, count(DISTINCT (cell_id, cycle_number)) AS bad_cycles, min(worst) AS worst FROM marks GROUP BY 1)
  SELECT dataset, cells, cycles, coalesce(bad_cells, 0) AS bad_cells, coalesce(bad_cycles, 0) AS bad_cycles, round(coalesce(worst, 0), 6) AS worst, round(100.0 * coalesce(bad_cells, 0) / cells, 4) AS cell_rate, round(100.0 * coalesce(bad_cycles, 0) / cycles, 4) AS cycle_rate FROM a LEFT JOIN b USING (dataset)""")
def i03_violation_summary(spark, sf_dir):
    return rounded(checks.violation_summary(_found(spark, sf_dir), _cycles(spark, sf_dir)), "worst", places=6)


@query(f"""WITH {fx.READINGS}, {MARKS}, a AS (SELECT dataset, cell_id, count(*) AS cycles FROM cyc GROUP BY 1, 2), b AS (SELECT dataset, cell_id, count(DISTINCT cycle_number) AS bad_cycles, min(worst) AS worst FROM marks GROUP BY 1, 2)
  SELECT dataset, cell_id, cycles, coalesce(bad_cycles, 0) AS bad_cycles, round(coalesce(worst, 0), 6) AS worst, round(100.0 * coalesce(bad_cycles, 0) / cycles, 4) AS cycle_rate FROM a LEFT JOIN b USING (dataset, cell_id)""")
def i04_violation_cell_stats(spark, sf_dir):
    return rounded(checks.violation_cell_stats(_found(spark, sf_dir), _cycles(spark, sf_dir)), "worst", places=6)


@query(f"WITH {fx.READINGS}, {VIOL} SELECT dataset, cell_id, cycle_number, phase, idx, round(diff, 10) AS diff FROM viol")
def i05_violation_detail(spark, sf_dir):
    return checks.violation_detail(_violations(spark, sf_dir))


@query(f"WITH {fx.READINGS}, {MARKS} SELECT dataset, cell_id, count(DISTINCT cycle_number) AS n FROM marks GROUP BY 1, 2")
def i06_violation_index(spark, sf_dir):
    return checks.violation_index(_found(spark, sf_dir)).select("dataset", CELL, F.size("cycles").cast("long").alias("n"))


@query(f"WITH {fx.READINGS}, {MARKS} SELECT dataset, cell_id, cycle_number, phase, count, round(worst, 8) AS worst FROM marks")
def i06_violation_index_entries(spark, sf_dir):
    """Every entry of the index, read back from its nested form."""
    cycles = checks.violation_index(_found(spark, sf_dir)).select("dataset", CELL, F.explode("cycles").alias("c"))
    phases = cycles.select("dataset", CELL, F.col("c.cycle_number").alias(CYC), F.explode("c.phases").alias("phase", "x"))
    return rounded(phases.select("dataset", CELL, CYC, "phase", "x.count", "x.worst"), "worst", places=8)


@query(f"""WITH {fx.READINGS}, {MARKS}, a AS (SELECT coalesce(dataset, 'TOTAL') AS dataset, count(*) AS cycles FROM cyc GROUP BY ROLLUP (dataset)), b AS (SELECT coalesce(dataset, 'TOTAL') AS dataset, count(DISTINCT (cell_id, cycle_number)) AS bad_cycles, count(DISTINCT cell_id) AS bad_cells, count_if(cycle_number <= 3) AS early, count_if(continuous) AS continuous, count_if(NOT continuous) AS discontinuous FROM marks GROUP BY ROLLUP (dataset))
  SELECT dataset, cycles, coalesce(bad_cycles, 0) AS bad_cycles, coalesce(bad_cells, 0) AS bad_cells, coalesce(early, 0) AS early, coalesce(continuous, 0) AS continuous, coalesce(discontinuous, 0) AS discontinuous, round(100.0 * coalesce(bad_cycles, 0) / cycles, 4) AS rate FROM a LEFT JOIN b USING (dataset)""")
def i07_violation_report(spark, sf_dir):
    return checks.violation_report(_found(spark, sf_dir), _cycles(spark, sf_dir), early=3)


@query(f"WITH {fx.READINGS}, {MARKS} SELECT continuous, least(count(*), 2) AS n FROM marks GROUP BY 1")
def i08_pick_examples(spark, sf_dir):
    return checks.pick_examples(_found(spark, sf_dir), "continuous").groupBy("continuous").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.READINGS}, {MARKS} SELECT continuous, least(count(*), 2) AS n, true AS known, true AS repeats, count(*) > 2 AS others FROM marks GROUP BY 1")
def i08_examples_by_seed(spark, sf_dir):
    """Picks are marks, the same for the same seed and others for another one where a group has more."""
    marks = _found(spark, sf_dir)
    key = ["dataset", CELL, CYC, "phase", "continuous"]
    one, again = (checks.pick_examples(marks, "continuous", seed=1).select(*key) for _ in range(2))
    seeds = [checks.pick_examples(marks, "continuous", seed=k).select(*key) for k in range(2, 6)]
    tell = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    others = tell(seeds[0].union(seeds[1]).union(seeds[2]).union(seeds[3]), "o").withColumnRenamed("continuous", "group").join(tell(one, "p").drop("continuous"), key[:-1], "left").where("p is null").groupBy("group").agg(F.lit(True).alias("others"))
    held = one.join(tell(marks.select(*key), "k"), key, "left").join(tell(again, "r"), key, "left")
    out = held.groupBy("continuous").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("k", F.lit(False))).alias("known"), F.bool_and(F.coalesce("r", F.lit(False))).alias("repeats"))
    return out.join(others, out["continuous"] == others["group"], "left").select("continuous", "n", "known", "repeats", F.coalesce("others", F.lit(False)).alias("others"))


@query(f"""WITH {fx.READINGS}, x AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) AS n FROM readings),
  y AS (SELECT cell_id, CASE WHEN event_id % 41 = 0 THEN v + CAST(0.25 AS DOUBLE) ELSE v END AS v, i * CAST(1.0000000001 AS DOUBLE) AS i, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) AS n FROM readings WHERE event_id % 50 <> 0 AND cell_id NOT LIKE '%7'),
  b AS (SELECT coalesce(x.cell_id, y.cell_id) AS cell_id, x.v AS va, y.v AS vb, abs(x.v - y.v) AS dv, abs(x.i - y.i) AS di FROM x FULL JOIN y ON y.cell_id = x.cell_id AND y.n = x.n)
  SELECT cell_id, count(va) AS n_before, count(vb) AS n_after, round(max(dv), 6) AS max_dv, round(max(di), 6) AS max_di, coalesce(max(dv) = 0 AND max(di) = 0, false) AS equal, coalesce(max(dv) <= 1e-6 AND max(di) <= 1e-6, false) AS close, count(va) = 0 OR count(vb) = 0 AS missing FROM b GROUP BY 1""")
def i09_compare_changed(spark, sf_dir):
    """Largest errors by place, equality, closeness and missing partners after rows were changed and dropped and whole cells left out."""
    r = fx.readings(spark, sf_dir)
    after = r.where((F.col("event_id") % 50 != 0) & ~F.col(CELL).endswith("7"))
    after = after.withColumns({"v": F.when(F.col("event_id") % 41 == 0, F.col("v") + 0.25).otherwise(F.col("v")), "i": F.col("i") * 1.0000000001})
    return rounded(checks.compare_before_after(r, after), "max_dv", "max_di", places=6)


@query(f"""WITH {fx.READINGS} SELECT cell_id, count(*) AS n_before, count_if(event_id % 50 <> 0) AS n_after FROM readings GROUP BY 1""")
def i09_compare_before_after(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    return checks.compare_before_after(r, r.where("event_id % 50 <> 0")).select(CELL, "n_before", "n_after")


@query(f"WITH {fx.READINGS} SELECT cell_id, count(*) AS n, round(sum(v), 4) AS v FROM readings WHERE cycle_number <= 2 GROUP BY 1")
def i10_flatten_for_inspection(spark, sf_dir):
    f = checks.flatten_for_inspection(fx.readings(spark, sf_dir), 2)
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return rounded(f.groupBy(CELL).agg(F.sum(F.size("v")).alias("n"), total.alias("v")), "v")


@query(f"""WITH {fx.READINGS}, p AS (SELECT cell_id, v, CASE WHEN event_id % 9 <> 0 THEN i END AS i, qd, t, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) - 1 AS place FROM readings WHERE cycle_number <= 3),
  n AS (SELECT cell_id, least(count(v), count(i), count(qd)) AS n FROM p GROUP BY 1)
  SELECT cell_id, place, round(v, 4) AS v, round(i, 4) AS i, round(qd, 4) AS qd, round(t, 6) AS t FROM p JOIN n USING (cell_id) WHERE place < n""")
def i10_flattened_points(spark, sf_dir):
    """Every point of the flattened series, some of whose currents are missing, from arrays of at most 16 points."""
    r = fx.readings(spark, sf_dir).withColumn("i", F.when(F.col("event_id") % 9 != 0, F.col("i")))
    f = checks.flatten_for_inspection(r, 3, size=16)
    zipped = f.select(CELL, "first", F.posexplode(F.arrays_zip("v", "i", "qd", "t")).alias("p", "x"))
    points = zipped.select(CELL, (F.col("first") + F.col("p")).alias("place"), "x.*")
    return rounded(points, "v", "i", "qd").withColumn("t", F.round("t", 6))


# --- J: metrics ---------------------------------------------------------------------------------------

M = "round(avg(abs(yhat - y)), 4) AS mae, round(avg((yhat - y) * (yhat - y)), 4) AS mse, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse, round(avg(abs(yhat - y) / abs(y)), 4) AS mape, round(avg((yhat - y) * (yhat - y) / (y * y)), 4) AS mspe"
ACC = "round(100 * avg(CAST(abs(yhat - y) / y <= 0.155 AS INTEGER)), 4) AS acc_16, round(100 * avg(CAST(abs(yhat - y) / y <= 0.105 AS INTEGER)), 4) AS acc_10"
ERR, ALPHAS = ("mae", "mse", "rmse", "mape", "mspe"), (0.155, 0.105)


@query(f"WITH {fx.PREDS} SELECT model, count(*) AS n, {M} FROM preds GROUP BY 1")
def j01_regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(fx.preds(spark, sf_dir), ["model"]), *ERR)


@query(f"""WITH {fx.PREDS}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY model) AS dy, yhat - avg(yhat) OVER (PARTITION BY model) AS dp FROM preds)
  SELECT model, round(sqrt(sum((y - yhat) * (y - yhat))) / sqrt(sum(dy * dy)), 4) AS rse, round(sum(dy * dp) / sqrt(sum(dy * dy * dp * dp)), 4) AS corr FROM m GROUP BY 1""")
def j02_rse_corr(spark, sf_dir):
    return rounded(metrics.rse_corr(fx.preds(spark, sf_dir), "model"), "rse", "corr")


@query(f"WITH {fx.PREDS} SELECT dataset, model, {ACC} FROM preds GROUP BY 1, 2")
def j03_alpha_accuracy(spark, sf_dir):
    return rounded(metrics.alpha_accuracy(fx.preds(spark, sf_dir), ["dataset", "model"], ALPHAS), "acc_16", "acc_10")


@query(f"WITH {fx.PREDS} SELECT CASE WHEN grouping(seen) = 1 THEN 'all' WHEN seen THEN 'seen' ELSE 'unseen' END AS part, count(*) AS n, {M}, {ACC} FROM preds GROUP BY GROUPING SETS ((), (seen))")
def j04_seen_unseen_metrics(spark, sf_dir):
    return rounded(metrics.seen_unseen_metrics(fx.preds(spark, sf_dir), ALPHAS), *ERR, "acc_16", "acc_10")


@query(f"WITH {fx.PREDS} SELECT n_seen, round(avg(abs(yhat - y) / abs(y)), 4) AS mape, {ACC} FROM preds GROUP BY 1")
def j05_metrics_by_seen_cycles(spark, sf_dir):
    return rounded(metrics.metrics_by_seen_cycles(fx.preds(spark, sf_dir), ALPHAS), "mape", "acc_16", "acc_10")


SCORES = "scores AS (SELECT model, dataset, seed, avg(abs(yhat - y) / abs(y)) AS mape FROM preds GROUP BY 1, 2, 3)"


def _scores(spark, sf_dir):
    return metrics.regression_metrics(fx.preds(spark, sf_dir), ["model", "dataset", "seed"])


@query(f"WITH {fx.PREDS}, {SCORES} SELECT model, dataset, round(avg(mape), 4) AS mean, round(stddev_pop(mape), 4) AS std FROM scores GROUP BY 1, 2")
def j06_mean_std_over_seeds(spark, sf_dir):
    return rounded(metrics.mean_std_over_seeds(_scores(spark, sf_dir), ["model", "dataset"], "mape"), "mean", "std")


@query(f"""WITH {fx.PREDS}, log AS (SELECT model AS run, n_seen AS epoch, round(avg(abs(yhat - y) / abs(y)), 3) AS val_mape, count(*) AS n FROM preds GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_mape, epoch) AS k FROM log)
  SELECT run, epoch, val_mape, n FROM r WHERE k = 1""")
def j07_best_epoch(spark, sf_dir):
    log = fx.preds(spark, sf_dir).groupBy(F.col("model").alias("run"), F.col("n_seen").alias("epoch"))
    log = log.agg(F.round(metrics.error_metrics()["mape"], 3).alias("val_mape"), F.count(F.lit(1)).alias("n"))
    return metrics.best_epoch(log)


@query(f"""WITH {fx.PREDS}, {SCORES}, m AS (SELECT model, dataset, avg(mape) AS mean, stddev_pop(mape) AS std FROM scores GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean, model) AS rank FROM m)
  SELECT dataset, CAST(rank AS INTEGER) AS rank, model, format('{{:.3f}}±{{:.3f}}', mean, std) AS text FROM r WHERE rank <= 3""")
def j08_leaderboard(spark, sf_dir):
    return metrics.leaderboard(_scores(spark, sf_dir), "mape")


@query(f"""WITH {fx.PREDS}, t AS (SELECT dataset, avg(y) AS yhat FROM preds WHERE seed = 0 GROUP BY 1), b AS (SELECT p.dataset, p.y, t.yhat FROM preds p JOIN t USING (dataset) WHERE seed <> 0)
  SELECT dataset, count(*) AS n, {M}, {ACC} FROM b GROUP BY 1""")
def j09_mean_label_baseline(spark, sf_dir):
    p = fx.preds(spark, sf_dir)
    return rounded(metrics.mean_label_baseline(p.where("seed = 0"), p.where("seed <> 0"), ALPHAS), *ERR, "acc_16", "acc_10", places=4)


@query(f"""WITH {fx.PREDS}, o AS (SELECT seed + 1 AS w, 0 AS output, y, yhat FROM preds UNION ALL SELECT seed + 1, 1, y * 2, yhat FROM preds)
  SELECT CAST(output AS INTEGER) AS output, round(sum(w * abs(yhat - y)) / sum(w), 4) AS mae, round(sum(w * (yhat - y) * (yhat - y)) / sum(w), 4) AS mse, round(sqrt(sum(w * (yhat - y) * (yhat - y)) / sum(w)), 4) AS rmse, round(sum(w * abs(yhat - y) / abs(y)) / sum(w), 4) AS mape FROM o GROUP BY 1""")
def j10_weighted_multioutput_metrics(spark, sf_dir):
    p = fx.preds(spark, sf_dir)
    rows = p.select((F.col("seed") + 1).alias("w"), F.array(F.col("y"), F.col("y") * 2).alias("y"), F.array("yhat", "yhat").alias("yhat"))
    return rounded(metrics.weighted_multioutput_metrics(rows), "mae", "mse", "rmse", "mape")


@query(f"""WITH {fx.PREDS} SELECT model, round(avg(CASE WHEN id % 3 <> 0 THEN abs(yhat - y) / abs(y) ELSE 0 END), 4) AS mape, round(200 * avg(CASE WHEN id % 3 <> 0 THEN abs(yhat - y) / (abs(y) + abs(yhat)) ELSE 0 END), 4) AS smape,
  round(avg(CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN abs(yhat - y) / (id % 5) ELSE 0 END), 4) AS mase FROM preds GROUP BY 1""")
def j11_masked_losses(spark, sf_dir):
    p = fx.preds(spark, sf_dir).withColumns({"mask": (F.col("id") % 3 != 0).cast("int"), "scale": (F.col("id") % 5).cast("double")})
    return rounded(metrics.masked_losses(p, ["model"]), "mape", "smape", "mase")


GROUPS = "CASE cell_id % 5 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Monthly' WHEN 3 THEN 'Weekly' ELSE 'Daily' END"


@query(f"""WITH {fx.PREDS}, s AS (SELECT {GROUPS} AS grp, cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY o_orderdate, id) AS idx, y, yhat FROM preds),
  n AS (SELECT *, CASE grp WHEN 'Quarterly' THEN lag(y, 4) OVER w WHEN 'Monthly' THEN lag(y, 3) OVER w ELSE lag(y, 1) OVER w END AS nv FROM s WINDOW w AS (PARTITION BY cell_id ORDER BY idx)),
  o AS (SELECT grp, cell_id, 200 * avg(abs(yhat - y) / (abs(y) + abs(yhat))) AS sm, 200 * avg(abs(nv - y) / (abs(y) + abs(nv))) AS sn, 100 * avg(abs(yhat - y) / abs(y)) AS mp, CASE WHEN avg(abs(nv - y)) <> 0 THEN avg(abs(yhat - y)) / avg(abs(nv - y)) END AS ms FROM n WHERE nv IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT CASE WHEN grp IN ('Yearly', 'Quarterly', 'Monthly') THEN grp ELSE 'Others' END AS grp, sm, sn, mp, ms FROM o UNION ALL SELECT 'Average', sm, sn, mp, ms FROM o)
  SELECT grp, round(avg(sm), 3) AS smape, round(avg(mp), 3) AS mape, round(avg(ms), 3) AS mase, round((avg(sm) / avg(sn) + avg(ms)) / 2, 3) AS owa FROM g GROUP BY 1""")
def j12_grouped_forecast_score(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Yearly", "Quarterly", "Monthly", "Weekly", "Daily")])
    p = fx.preds(spark, sf_dir).withColumn("grp", F.get(names, (F.col(CELL) % 5).cast("int"))).withColumnRenamed(CELL, "series")
    p = p.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("o_orderdate", "id")))
    return metrics.grouped_forecast_score(p.select("grp", "series", "idx", "y", "yhat"), {"Quarterly": 4, "Monthly": 3})


@query(f"""WITH {fx.SERIES}, n AS (SELECT count(*) AS n, count(*) FILTER (id % 2 = 0) AS n0, count(*) FILTER (id % 2 = 1) AS n1 FROM series WHERE x IS NOT NULL),
  d AS (SELECT CASE WHEN a.id % 2 = b.id % 2 THEN CASE WHEN a.id % 2 = 0 THEN 1 / n0 / n0 ELSE 1 / n1 / n1 END ELSE -1 / n0 / n1 END AS w, n, list_distance(a.x, b.x) ** 2 AS d
    FROM series a, series b, n WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
  h AS (SELECT sum(d) / (max(n) * CAST(max(n) AS DOUBLE) - max(n)) AS h FROM d)
  SELECT round(sum(w * (exp(-d / h * 4) + exp(-d / h * 2) + exp(-d / h) + exp(-d / h / 2) + exp(-d / h / 4))), 8) AS mmd FROM d, h""")
def j13_mmd_rbf(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumn("side", (F.col("id") % 2).cast("int"))
    return rounded(metrics.mmd_rbf(s, "x"), "mmd", places=8)


@query(f"""WITH {fx.PREDS}, s AS (SELECT cell_id AS series, row_number() OVER (PARTITION BY cell_id ORDER BY id) AS idx, CAST((id // 3) % 2 AS INTEGER) AS truth, CAST(id % 4 = 0 AS INTEGER) AS pred FROM preds),
  c AS (SELECT *, coalesce(CAST(truth <> lag(truth) OVER w AS INTEGER), 1) AS nw FROM s WINDOW w AS (PARTITION BY series ORDER BY idx)), r AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT series, idx, CASE WHEN truth = 1 AND idx > 1 THEN max(pred) OVER (PARTITION BY series, run) ELSE pred END AS adjusted FROM r""")
def j14_point_adjust(spark, sf_dir):
    return metrics.point_adjust(_points(spark, sf_dir)).select("series", "idx", "adjusted")


def _points(spark, sf_dir):
    k = F.col("id")
    p = fx.preds(spark, sf_dir).select(F.col(CELL).alias("series"), k, (F.floor(k / 3) % 2).cast("int").alias("truth"), (k % 4 == 0).cast("int").alias("pred"))
    return p.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("id")).cast("long"))


@query(f"WITH {fx.PREDS} SELECT cell_id AS series, round(avg(CAST((id // 3) % 2 = CAST(id % 4 = 0 AS INTEGER) AS INTEGER)), 4) AS accuracy FROM preds GROUP BY 1")
def j15_accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(_points(spark, sf_dir), ["series"]), "accuracy")


@query("""WITH p AS (SELECT user_id AS grp, event_type AS item, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS prob FROM events GROUP BY 1, 2),
  c AS (SELECT *, sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, item ROWS UNBOUNDED PRECEDING) AS cum FROM p), k AS (SELECT * FROM c WHERE cum - prob <= 0.6543)
  SELECT grp, item, round(prob / sum(prob) OVER (PARTITION BY grp), 4) AS prob FROM k""")
def j16_nucleus_filter(spark, sf_dir):
    n = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    p = n.select("grp", "item", (F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("prob"))
    return rounded(metrics.nucleus_filter(p, 0.6543)[0], "prob")


@query(f"""WITH p AS (SELECT user_id AS grp, event_type AS item, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS prob FROM events GROUP BY 1, 2),
  c AS (SELECT *, sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, item ROWS UNBOUNDED PRECEDING) AS cum FROM p), k AS (SELECT grp, item, prob / sum(prob) OVER (PARTITION BY grp) AS prob FROM c WHERE cum - prob <= 0.8543),
  d AS (SELECT *, sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, item ROWS UNBOUNDED PRECEDING) AS cum FROM k) SELECT grp, arg_min(item, cum) AS item FROM d WHERE cum > {uniform_sql('grp', '3')} GROUP BY 1""")
def j16_nucleus_draw(spark, sf_dir):
    """The seeded draw of each group."""
    n = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    p = n.select("grp", "item", (F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("prob"))
    return metrics.nucleus_filter(p, 0.8543, seed=3)[1]


@query("""SELECT c AS n, round(b0, 3) AS intercept, round(b1, 3) AS slope FROM (SELECT count(*) AS c, regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1 FROM lineitem)""")
def j17_linear_life_model(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("label"))
    model = metrics.linear_life_model(rows, ["x"], ridge=0.0).stages[-1]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(float(model.intercept)), 3).alias("intercept"), F.round(F.lit(float(model.coefficients[0])), 3).alias("slope"))


@query(f"""WITH {fx.HEALTH}, f AS (SELECT cell_id, n_seen, sum(soh) FILTER (cycle_number <= n_seen) / n_seen AS x, 1000 * arg_max(soh, cycle_number) AS y, CASE WHEN cell_id % 5 < 3 THEN 'train' WHEN cell_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
    FROM health, (SELECT unnest([5, 20, 60]) AS n_seen) GROUP BY 1, 2),
  m AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM f WHERE split = 'train'), p AS (SELECT split, y, b0 + b1 * x AS yhat FROM f, m)
  SELECT split, count(*) AS n, round(avg(abs(yhat - y)), 4) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse, round(avg(abs(yhat - y) / abs(y)), 4) AS mape FROM p GROUP BY 1""")
def j17_linear_life_model_pooled(spark, sf_dir):
    """One pooled, masked feature: the standardised life fitted on train, all splits scored and scaled back."""
    h = fx.health(spark, sf_dir)
    label = h.groupBy(CELL).agg((1000 * F.max_by("soh", CYC)).alias("label"))
    seen = label.withColumn("n_seen", F.explode(F.array(F.lit(5), F.lit(20), F.lit(60))))
    curve = h.select(CELL, CYC, F.array("soh").alias("v"))
    pooled = curves.apply_prefix_mask(seen, curve, ["v"]).groupBy(CELL, "n_seen", "label").agg((F.sum(F.get("v", 0)) / F.col("n_seen")).alias("x"))
    pooled = pooled.withColumn("split", F.when(F.col(CELL) % 5 < 3, "train").when(F.col(CELL) % 5 == 3, "val").otherwise("test"))
    z = curves.standardise_labels(pooled, pooled.where("split = 'train'"))
    model = metrics.linear_life_model(z.where("split = 'train'"), ["x"], "label_z", ridge=0.0)
    scored = metrics.batch_score(model, z, ["split", CELL, F.col("label").alias("y")], "mean", "std")
    m = metrics.error_metrics((0.15, 0.10))
    return rounded(scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[m[k].alias(k) for k in ("mae", "rmse", "mape")]), "mae", "rmse", "mape")


def life_samples(spark, sf_dir, threshold: int = 6):
    """Samples of all cells that have readings: label, split and the pooled, masked curve features of the cycles seen.

    Readings cover six cycles. Returns the samples and the names of their features.
    """
    c = fx.cells(spark, sf_dir).select(F.concat(F.lit("c"), F.col("num").cast("string")).alias(CELL), "eol", F.col(CELL).alias("name"))
    split = fx.splits(spark, sf_dir).select(F.col(CELL).alias("name"), "split")
    curve = curves.cycle_curves(segment.phase_slices(fx.readings(spark, sf_dir), 1.0), 1.1, 20)
    padded = curves.pad_missing_cycles(curve, threshold, 20, list("vcq"))
    life_of = c.join(curve.groupBy(CELL).agg(F.max(CYC).alias("valid_cycles")), CELL)
    samples = curves.expand_samples(life_of, 1, threshold).join(c.join(split, "name").select(CELL, "split"), CELL)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    halves = {f"{x}_{h}": F.sum(total(F.slice(x, 1 + 10 * k, 10))) / (10 * F.col("n_seen")) for x in "vcq" for k, h in enumerate(("charge", "discharge"))}
    pooled = curves.apply_prefix_mask(samples, padded, list("vcq")).groupBy(CELL, "n_seen", "label", "split").agg(*[e.alias(k) for k, e in halves.items()])
    return pooled, list(halves)


@query()
def j17_linear_life_model_curves(spark, sf_dir):
    """The standardised life on pooled, masked curve features: fitted on train, all splits scored."""
    pooled, features = life_samples(spark, sf_dir)
    path = scratch(spark, "samples")  # read by the fit and the scores, each of several jobs
    pooled.write.parquet(path)
    pooled = spark.read.parquet(path)
    z = curves.standardise_labels(pooled, pooled.where("split = 'train'"))
    model = metrics.linear_life_model(z.where("split = 'train'"), features, "label_z")
    scored = metrics.batch_score(model, z, ["split", CELL, "n_seen", F.col("label").cast("double").alias("y")], "mean", "std")
    m = {k: e.alias(k) for k, e in metrics.error_metrics((0.15, 0.10)).items()}
    return rounded(scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *m.values()), *m)


@query(f"""WITH {fx.PREDS}, m AS (SELECT regr_slope(y, n_seen) AS b, regr_intercept(y, n_seen) AS a FROM preds WHERE seed = 0)
  SELECT id, dataset, seen, n_seen, y, round(a + b * n_seen, 3) AS yhat FROM preds, m""")
def j18_batch_score(spark, sf_dir):
    p = fx.preds(spark, sf_dir).withColumn("label", F.col("y"))
    model = metrics.linear_life_model(p.where("seed = 0").drop("yhat"), ["n_seen", "seed"])
    return rounded(metrics.batch_score(model, p.drop("yhat"), ["id", "dataset", "seen", "n_seen", "y"]), "yhat", places=3)

"""The operators' tables, derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_US = 1_704_067_200_000_000  # 2024-01-01
CYCLE_US = 432_000_000_000  # five days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(START_US)
    kind, k = F.col("event_type"), F.col("event_id")
    cycle = (F.floor(us / F.lit(float(CYCLE_US))) + 1).cast("int")
    value = F.col("value") / 100
    current = F.when(kind.isin("purchase", "click"), value).when(kind.isin("view", "error"), -value).otherwise(0.0)
    rows = e.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cell_id"), cycle.alias("cycle_number"),
        (F.pmod(us, F.lit(CYCLE_US)) / 1e6).alias("t"), current.alias("i"), (3 + (k % 1000) / 1000).alias("v"),
        F.when(k % 23 == 0, -0.01).otherwise((k % 50) / 40).alias("qc"), F.when(k % 29 == 0, -0.01).otherwise((k % 47) / 40).alias("qd"),
        F.when(k % 11 != 0, 20 + (k % 150) / 10).alias("temp"), k.alias("event_id"), kind.alias("event_type"), "ts", "props",
    )
    w = Window.partitionBy("cell_id", "cycle_number").orderBy("ts", "event_id")
    return rows.withColumn("idx", F.row_number().over(w))


READINGS = f"""readings AS (
  SELECT 'c' || user_id AS cell_id, CAST((epoch_us(ts) - {START_US}) // {CYCLE_US} + 1 AS INTEGER) AS cycle_number,
    ((epoch_us(ts) - {START_US}) % {CYCLE_US}) / 1e6 AS t,
    CASE WHEN event_type IN ('purchase', 'click') THEN value / 100 WHEN event_type IN ('view', 'error') THEN -value / 100 ELSE 0 END AS i,
    3 + (event_id % 1000) / 1000 AS v,
    CASE WHEN event_id % 23 = 0 THEN CAST(-0.01 AS DOUBLE) ELSE (event_id % 50) / 40 END AS qc,
    CASE WHEN event_id % 29 = 0 THEN CAST(-0.01 AS DOUBLE) ELSE (event_id % 47) / 40 END AS qd,
    CASE WHEN event_id % 11 <> 0 THEN 20 + (event_id % 150) / 10 END AS temp, event_id, event_type, ts, props,
    CAST(row_number() OVER (PARTITION BY user_id, (epoch_us(ts) - {START_US}) // {CYCLE_US} ORDER BY ts, event_id) AS INTEGER) AS idx
  FROM events)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose clock restarts now and then."""
    return readings(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 37 == 0, 0.0).otherwise(F.col("t")))


FAULTY = READINGS + ", faulty AS (SELECT * REPLACE (CASE WHEN event_id % 37 = 0 THEN 0 ELSE t END AS t) FROM readings)"


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of falling health: cell_id, cycle_number, soh."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.date_trunc("month", "l_shipdate").alias("m")).agg(F.avg("l_quantity").alias("q"))
    n = m.withColumn("cycle_number", F.row_number().over(Window.partitionBy("cell_id").orderBy("m")))
    fade = F.lit(0.0001) * (F.col("cell_id") % 50 + 5) * F.col("cycle_number")
    return n.select("cell_id", "cycle_number", (F.lit(1.05) - fade + (F.col("q") - 25.5) / 1000).alias("soh"))


HEALTH = """months AS (SELECT l_suppkey AS cell_id, date_trunc('month', l_shipdate) AS m, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY m) AS INTEGER) AS cycle_number FROM months),
health AS (SELECT cell_id, cycle_number, CAST(1.05 AS DOUBLE) - CAST(0.0001 AS DOUBLE) * (cell_id % 50 + 5) * cycle_number + (q - 25.5) / 1000 AS soh FROM numbered)"""


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle capacities with outliers: cell_id, cycle_number, qd_max."""
    odd = F.when((F.col("cell_id") * 7 + F.col("cycle_number")) % 31 == 0, 0.5).otherwise(0.0)
    return health(spark, sf_dir).select("cell_id", "cycle_number", (F.col("soh") + odd).alias("qd_max"))


CAPS = HEALTH + ", caps AS (SELECT cell_id, cycle_number, soh + CASE WHEN (cell_id * 7 + cycle_number) % 31 = 0 THEN 0.5 ELSE 0 END AS qd_max FROM health)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battery cells from suppliers, named as their datasets name them."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    chem = F.element_at(F.array(F.lit("LFP"), F.lit("NCA"), F.lit("NMC")), (k % 3 + 1).cast("int"))
    temp = F.element_at(F.array(F.lit("15"), F.lit("25"), F.lit("35")), (F.floor(k / 3) % 3 + 1).cast("int"))
    snl = F.concat(F.lit("SNL_18650_"), chem, F.lit("_"), temp, F.when(k % 2 == 0, "C_20-80_").otherwise("C_0-100_"), F.lit("0.5-"), (k % 3 + 1).cast("string"), F.lit("C_"), s)
    name = F.when(k % 5 < 2, snl).when(k % 5 == 2, F.concat(F.lit("CALB_"), temp, F.lit("_B"), s)).when(k % 5 == 3, F.concat(F.lit("ZN-coin_"), s)).otherwise(F.concat(F.lit("MATR_b1c"), s))
    data = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return data.select(
        name.alias("cell_id"), k.alias("num"), F.col("r_name").alias("dataset"), chem.alias("cathode"), F.when(k % 4 == 0, "graphite").otherwise("silicon").alias("anode"),
        F.when(k % 7 == 0, "gel").otherwise("liquid").alias("electrolyte"), (F.col("s_acctbal") / 1000).alias("stored"), F.col("n_nationkey").cast("long").alias("condition"),
        (F.floor(F.col("s_acctbal") / 4).cast("int")).alias("eol"),
    )


CELLS = """cells AS (
  SELECT CASE WHEN s_suppkey % 5 < 2 THEN 'SNL_18650_' || ['LFP', 'NCA', 'NMC'][s_suppkey % 3 + 1] || '_' || ['15', '25', '35'][(s_suppkey // 3) % 3 + 1]
        || CASE WHEN s_suppkey % 2 = 0 THEN 'C_20-80_' ELSE 'C_0-100_' END || '0.5-' || (s_suppkey % 3 + 1) || 'C_' || s_suppkey
      WHEN s_suppkey % 5 = 2 THEN 'CALB_' || ['15', '25', '35'][(s_suppkey // 3) % 3 + 1] || '_B' || s_suppkey
      WHEN s_suppkey % 5 = 3 THEN 'ZN-coin_' || s_suppkey ELSE 'MATR_b1c' || s_suppkey END AS cell_id,
    s_suppkey AS num, r_name AS dataset, ['LFP', 'NCA', 'NMC'][s_suppkey % 3 + 1] AS cathode, CASE WHEN s_suppkey % 4 = 0 THEN 'graphite' ELSE 'silicon' END AS anode,
    CASE WHEN s_suppkey % 7 = 0 THEN 'gel' ELSE 'liquid' END AS electrolyte, s_acctbal / 1000 AS stored, CAST(n_nationkey AS BIGINT) AS condition,
    CAST(floor(s_acctbal / 4) AS INTEGER) AS eol
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("num") % 5 < 3, "train").when(F.col("num") % 5 == 3, "val").otherwise("test")
    return cells(spark, sf_dir).select("dataset", F.lit(2021).alias("seed"), part.alias("split"), "cell_id")


SPLITS = CELLS + ", splits AS (SELECT dataset, 2021 AS seed, CASE WHEN num % 5 < 3 THEN 'train' WHEN num % 5 = 3 THEN 'val' ELSE 'test' END AS split, cell_id FROM cells)"


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), (k % 3).cast("int").alias("seed"), F.col("o_custkey").alias("cell_id"), (k % 100 + 1).cast("int").alias("n_seen"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("dataset"), (F.col("o_orderstatus") == "F").alias("seen"),
        (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_totalprice") / 1000 * (0.8 + (k % 41) / 100)).alias("yhat"), k.alias("id"), "o_orderdate",
    )


PREDS = """preds AS (SELECT o_orderpriority AS model, CAST(o_orderkey % 3 AS INTEGER) AS seed, o_custkey AS cell_id, CAST(o_orderkey % 100 + 1 AS INTEGER) AS n_seen,
    'd' || (o_custkey % 4) AS dataset, o_orderstatus = 'F' AS seen, o_totalprice / 1000 AS y, o_totalprice / 1000 * (CAST(0.8 AS DOUBLE) + (o_orderkey % 41) / 100) AS yhat,
    o_orderkey AS id, o_orderdate FROM orders)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves from the embeddings: id, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


SERIES = "series AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"

"""One query for each telemetry operator, over the tables of ``fixtures``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclespark.functions import parse
from cyclespark.functions.windows import in_cell, placed
from cyclespark.operators import checks, clean, cohort, curves, life, metrics, segment, timeaxis
from cyclespark.sources import readers, writers
from cyclespark.sources.shared import scratch
from cyclespark.streaming.ingest import ingest_new_files

from . import fixtures as fx
from .registry import query, rounded

CELL, CYC = "cell_id", "cycle_number"
KEY = [CELL, CYC, "idx"]

# --- the flagship: readings to life labels ---------------------------------------------

COULOMB = """counted AS (SELECT *, sum(CASE WHEN i > 0 THEN coalesce(i * (t - pt) / 3600, 0) ELSE 0 END) OVER w AS qc2,
    sum(CASE WHEN i < 0 THEN -coalesce(i * (t - pt) / 3600, 0) ELSE 0 END) OVER w AS qd2
  FROM (SELECT * EXCLUDE (pt), lag(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS pt FROM fixed)
  WINDOW w AS (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS UNBOUNDED PRECEDING))"""

FIXED = """fixed AS (SELECT * REPLACE (coalesce(sum(gain) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS t) FROM
  (SELECT *, CASE WHEN pt IS NULL THEN 0 WHEN t = 0 OR (t < 0.5 * pt AND pt > 10) OR t < pt - 100 THEN 0 WHEN t - pt > 300 THEN 1 ELSE t - pt END AS gain
   FROM (SELECT *, lag(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS pt FROM faulty)))"""

LABEL = """placed AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS pos, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number DESC) AS back FROM health),
line AS (SELECT cell_id, regr_intercept(cycle_number, soh) + regr_slope(cycle_number, soh) * {end} AS line FROM placed WHERE back <= {k} GROUP BY 1),
ends AS (SELECT cell_id, arg_max(soh, cycle_number) AS last_soh, min(pos) FILTER (soh <= {end}) AS first FROM placed GROUP BY 1)"""


def _flagship_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = segment.coulomb_count(timeaxis.fix_time_resets(fx.faulty(spark, sf_dir)))
    per = r.groupBy(CELL, CYC).agg(F.max("qd").alias("q"))
    first = F.first("q").over(in_cell())
    return per.withColumn("soh", F.round(F.try_divide(F.col("q"), first), 6)).where("soh is not null").select(CELL, CYC, "soh")


FLAG_HEALTH = (
    f"WITH {fx.FAULTY}, {FIXED}, {COULOMB}, per AS (SELECT cell_id, cycle_number, max(qd2) AS q FROM counted GROUP BY 1, 2), "
    "ratio AS (SELECT cell_id, cycle_number, q, first_value(q) OVER (PARTITION BY cell_id ORDER BY cycle_number) AS q0 FROM per), "
    "health AS (SELECT cell_id, cycle_number, round(q / q0, 6) AS soh FROM ratio WHERE q0 <> 0)"
)


@query(FLAG_HEALTH + ", " + LABEL.format(end=0.8, k=3) + """ SELECT cell_id, last_soh,
  CAST(CASE WHEN last_soh >= 0.825 THEN NULL WHEN last_soh > 0.8 THEN trunc(line) ELSE first END AS INTEGER) AS eol FROM ends LEFT JOIN line USING (cell_id)""")
def flagship_life_labels(spark, sf_dir):
    return life.life_label(_flagship_health(spark, sf_dir), k=3)


# --- A: sources and sinks ----------------------------------------------------------------

READ_SQL = f"WITH {fx.READINGS} SELECT cell_id, count(*) AS n, round(sum(i), 4) AS total_i, round(max(t), 6) AS t_max FROM readings GROUP BY 1"


def _digest(df: DataFrame) -> DataFrame:
    return rounded(df.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total_i"), F.max("t").alias("t_max")), "total_i").withColumn("t_max", F.round("t_max", 6))


@query(f"WITH {fx.READINGS} SELECT cycle_number, count(*) AS n, round(sum(i), 4) AS total_i, round(max(t), 6) AS t_max FROM readings GROUP BY 1")
def a01_read_cycler_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    r = fx.readings(spark, sf_dir).select(CELL, CYC, "idx", "t", "i", "v")
    r.repartition(4).write.option("header", True).csv(path)
    back = readers.read_cycler_csv(spark, path, "cell_id string, cycle_number int, idx int, t double, i double, v double", r"^(part)-")
    return rounded(back.drop(CELL).groupBy(CYC).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total_i"), F.max("t").alias("t_max")), "total_i").withColumn("t_max", F.round("t_max", 6))


@query(f"WITH {fx.READINGS} SELECT 'cell_' || (event_id % 3) AS cell_id, cycle_number, count(*) AS n, round(sum(i), 4) AS total_i, max(idx) AS last_idx FROM readings GROUP BY 1, 2")
def a01_cell_from_file_name(spark, sf_dir):
    """Three cells in several files each, known by the names of the files only."""
    path = scratch(spark, "named")
    r = fx.readings(spark, sf_dir)
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(3):
        r.where(F.col("event_id") % 3 == k).select(CYC, "idx", "t", "i", "v").repartition(2).write.option("header", True).csv(f"{path}-{k}")
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
        for n, x in enumerate(files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}-{k}/part-*"))):
            files.rename(x.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/cell_{k}_timeseries_{n}.csv"))
    back = readers.read_cycler_csv(spark, path, "cycle_number int, idx int, t double, i double, v double")
    return rounded(back.groupBy(CELL, CYC).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total_i"), F.max("idx").alias("last_idx")), "total_i")


@query(f"WITH {fx.READINGS} SELECT cycle_number // 2 + 1 AS cycle_number, count(*) AS n, round(sum(i), 4) AS total_i FROM readings GROUP BY 1")
def a02_read_tab_log(spark, sf_dir):
    path = scratch(spark, "tab")
    r = fx.readings(spark, sf_dir)
    r.select(F.col(CYC).alias("Charge count"), F.col("t").alias("Time"), (F.col("i") * 1000).alias("mA"), (F.col("v") * 1000).alias("mV")).write.option("header", True).option("sep", "\t").csv(path)
    back = readers.read_tab_log(spark, path).groupBy(CYC).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total_i"))
    return rounded(back, "total_i")


@query(f"WITH {fx.READINGS} SELECT count(*) AS n, round(sum(i), 4) AS total_i FROM readings")
def a03_read_csv_skip_unit_row(spark, sf_dir):
    path = scratch(spark, "units")
    r = fx.readings(spark, sf_dir).select(F.col("t").cast("string").alias("Zeit"), F.col("i").cast("string").alias("Strom"))
    units = spark.range(1).select(F.lit("s").alias("Zeit"), F.lit("A").alias("Strom"))
    units.unionByName(r).write.option("header", True).csv(path)
    back = readers.read_csv_skip_unit_row(spark, [path], ["Zeit", "Strom"])
    return rounded(back.agg(F.count(F.lit(1)).alias("n"), F.sum("Strom").alias("total_i")), "total_i")


@query(f"WITH {fx.READINGS} SELECT cycle_number, count(*) AS n FROM readings GROUP BY 1")
def a04_read_csv_charset(spark, sf_dir):
    path = scratch(spark, "gbk")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    fx.readings(spark, sf_dir).select(F.col(CYC).alias("循环号"), F.col("v").alias("电压")).write.option("header", True).option("encoding", "GBK").csv(path)
    back = readers.read_csv_charset(spark, path, "GBK", [CYC, "v"])
    return back.groupBy(F.col(CYC).cast("int").alias(CYC)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.READINGS} SELECT idx, round(sum(v), 4) AS total_v FROM readings GROUP BY 1")
def a05_read_nested_json(spark, sf_dir):
    path = scratch(spark, "json")
    r = fx.readings(spark, sf_dir)
    arrays = r.groupBy(CELL, CYC).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p")).select(F.struct(F.col("p.v").alias("voltage")).alias("cycles_interpolated"))
    arrays.write.json(path)
    back = readers.read_nested_json(spark, path, {"voltage": "double"}, multi_line=False)
    return rounded(back.groupBy("idx").agg(F.sum("voltage").alias("total_v")), "total_v")


@query(f"WITH {fx.READINGS} SELECT cell_id, count(*) AS n, round(sum(CASE WHEN i > 0 THEN qc ELSE 0 END), 4) AS charge, round(sum(CASE WHEN i > 0 THEN 0 ELSE qd END), 4) AS discharge FROM readings GROUP BY 1")
def a05_decode_phase_json(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    half = lambda c, q: F.struct(
        *[F.array(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(*KEY[1:], F.col(x).alias("y"))))), lambda z: z["y"])).alias(n) for n, x in (("I", "i"), ("V", "v"), ("Q", q), ("t", "t"))]
    )
    docs = r.groupBy(CELL).agg(F.to_json(F.struct(half(F.col("i") > 0, "qc").alias("QV_charge"), half(~(F.col("i") > 0), "qd").alias("QV_discharge"))).alias("doc"))
    back = readers.decode_phase_json(docs, "doc")
    return rounded(back.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("qc").alias("charge"), F.sum("qd").alias("discharge")), "charge", "discharge")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def a06_read_parquet_projected(spark, sf_dir):
    rows = readers.read_parquet_projected(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey"], ["l_suppkey", "l_quantity", "absent"])
    return rounded(rows.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")), "q", places=2)


@query(f"WITH {fx.READINGS}, dense AS (SELECT *, dense_rank() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS c FROM readings) SELECT cell_id, CAST(c AS INTEGER) AS cycle_number, count(*) AS n, max(idx) AS last_idx FROM dense GROUP BY 1, 2")
def a07_explode_cells(spark, sf_dir):
    nested = readers.nested_cells(fx.readings(spark, sf_dir))
    return readers.explode_cells(nested).groupBy(CELL, CYC).agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"))


@query(f"WITH {fx.READINGS} SELECT cell_id, count(DISTINCT cycle_number) AS cycles, count(*) AS points FROM readings GROUP BY 1")
def a08_nest_readings(spark, sf_dir):
    nested = readers.nest_readings(fx.readings(spark, sf_dir))
    back = readers.unnest_readings(nested).groupBy(CELL).agg(F.count_distinct(CYC).alias("cycles"))
    return nested.groupBy(CELL).agg(F.sum(F.size("points")).alias("points")).join(back, CELL)


@query(f"WITH {fx.READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) - 1 AS place FROM readings) SELECT cell_id, place, place // 64 AS chunk, cycle_number, idx, round(t, 6) AS t, round(i, 4) AS i, round(v, 4) AS v FROM p")
def a08_chunks_round_trip(spark, sf_dir):
    """Every reading, read back from records of at most 64 points with its place in the cell."""
    nested = readers.nest_readings(fx.readings(spark, sf_dir), size=64)
    rows = readers.from_chunks(nested).withColumn("chunk", F.floor(F.col("place") / 64))
    return rounded(rows.select(CELL, "place", "chunk", CYC, "idx", F.round("t", 6).alias("t"), "i", "v"), "i", "v")


@query(f"WITH {fx.CELLS} SELECT count_if(num % 3 <> 0) AS processed, count_if(num % 3 = 0) AS skipped FROM cells")
def a09_resume_ingest(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return readers.resume_ingest(c, c.where("num % 3 = 0"))[1]


@query(READ_SQL)
def a09_streaming_ingest(spark, sf_dir):
    source, target, marks = (scratch(spark, x) for x in ("in", "out", "marks"))
    r = fx.readings(spark, sf_dir).select(CELL, CYC, "idx", "t", "i")
    schema = "cell_id string, cycle_number int, idx int, t double, i double"
    r.where("cycle_number <= 3").write.parquet(source)
    ingest_new_files(spark, source, schema, target, marks, lambda d: d)
    r.where("cycle_number > 3").write.mode("append").parquet(source)
    ingest_new_files(spark, source, schema, target, marks, lambda d: d)
    return _digest(spark.read.parquet(target).drop("batch"))


@query(f"WITH {fx.CELLS} SELECT dataset, count(*) AS n, sum(eol) AS total FROM cells WHERE eol IS NOT NULL GROUP BY 1")
def a10_read_label_maps(spark, sf_dir):
    path = scratch(spark, "labels")
    writers.write_labels(fx.cells(spark, sf_dir).select("dataset", CELL, "eol"), path)
    maps = readers.read_label_maps(spark, f"{path}/*/")
    named = maps.withColumn(CELL, F.regexp_replace("file", r"\.pkl$", "")).join(fx.cells(spark, sf_dir).select("dataset", CELL), CELL)
    return named.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("eol").alias("total"))


@query(f"WITH {fx.CELLS} SELECT dataset, count(*) AS n, max(cell_id) AS last FROM cells GROUP BY 1")
def a11_write_cells(spark, sf_dir):
    path, report = scratch(spark, "cells"), scratch(spark, "report")
    writers.write_cells(fx.cells(spark, sf_dir), path)
    writers.write_report(spark.read.parquet(path), ["dataset", CELL], report)
    return spark.read.option("header", True).csv(report).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max(CELL).alias("last"))


@query(f"WITH {fx.CELLS} SELECT cell_id, cathode, CAST(NULL AS VARCHAR) AS anode FROM cells WHERE num % 2 = 0 UNION ALL SELECT cell_id, NULL, anode FROM cells WHERE num % 2 = 1")
def a12_union_sheets(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return readers.union_sheets([c.where("num % 2 = 0").select(CELL, "cathode"), c.where("num % 2 = 1").select(CELL, "anode")])


# --- B: projection, parsing, filters --------------------------------------------------------


@query(f"""WITH {fx.CELLS} SELECT cell_id, CASE WHEN split_part(cell_id, '_', 1) = 'CALB' THEN 'CALB_' || split_part(cell_id, '_', 2) ELSE split_part(cell_id, '_', 1) END AS prefix,
  TRY_CAST(split_part(left(tok, greatest(length(tok) - 1, 0)), '-', 1) AS DOUBLE) AS charge, TRY_CAST(split_part(left(tok, greatest(length(tok) - 1, 0)), '-', 2) AS DOUBLE) AS discharge
  FROM (SELECT *, string_split(cell_id, '_')[-2] AS tok FROM cells)""")
def b01_parse_cell_name(spark, sf_dir):
    name = F.col(CELL)
    rates = parse.name_rates(name)
    return fx.cells(spark, sf_dir).select(CELL, parse.name_prefix(name).alias("prefix"), rates["charge"].alias("charge"), rates["discharge"].alias("discharge"))


@query(f"""WITH {fx.CELLS} SELECT cell_id, CAST(CASE WHEN num % 10 = 4 THEN 7 WHEN cell_id LIKE 'SNL%' THEN 5 WHEN cell_id LIKE 'ZN-coin%' THEN 13 WHEN cell_id LIKE 'MATR%' THEN 3 END AS INTEGER) AS dataset_id FROM cells""")
def b02_dataset_id(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return clean.dataset_id(c, c.where("num % 10 = 4").select(CELL, F.lit(7).alias("id"))).select(CELL, "dataset_id")


@query(f"WITH {fx.CELLS} SELECT cell_id, CASE WHEN cell_id LIKE 'SNL_18650_NCA_25C_20-80%' THEN 3.2 ELSE coalesce(stored, 0) END AS nominal FROM cells")
def b03_nominal_capacity(spark, sf_dir):
    return fx.cells(spark, sf_dir).select(CELL, parse.nominal_capacity(F.col(CELL), F.col("stored")).alias("nominal"))


@query(f"""WITH {fx.CELLS} SELECT cell_id, CAST(CASE WHEN cell_id LIKE 'SNL%NMC%15C%' THEN 2.7 WHEN cell_id LIKE 'SNL%NMC%' THEN 3 WHEN cell_id LIKE 'SNL%NCA%20-80%' THEN 3.2
  WHEN cell_id LIKE 'SNL%NCA%15C%' THEN 2.88 WHEN cell_id LIKE 'SNL%NCA%' THEN 3.2 WHEN cell_id LIKE 'SNL%' THEN 1.1 WHEN num % 5 = 2 AND num % 2 = 0 THEN 3.4 * 0.94 * 3.4 WHEN num % 5 = 2 THEN 3.4
  WHEN num % 5 = 3 THEN CASE WHEN num % 124 BETWEEN 1 AND 19 THEN 73 WHEN num % 124 BETWEEN 20 AND 112 THEN 76 WHEN num % 124 BETWEEN 113 AND 123 THEN 84 ELSE 0 END END AS DOUBLE) AS nominal FROM cells""")
def b03_nominal_capacity_by_name(spark, sf_dir):
    num, name = F.col("num"), F.col(CELL)
    ul = F.concat(F.lit("UL-PUR_N20-"), name, F.when(num % 2 == 0, "_2.5-96.5").otherwise("_0-100"))
    other = F.concat(F.lit("Farasis_x_"), F.lpad((num % 124).cast("string"), 3, "0"), F.lit("_single_parquet"))
    named = F.when(num % 5 == 2, ul).when(num % 5 == 3, other).otherwise(name)
    return rounded(fx.cells(spark, sf_dir).select(CELL, parse.named_capacity(named).alias("nominal")), "nominal", places=6)


@query(f"""WITH {fx.CELLS} SELECT cell_id, CASE WHEN cell_id LIKE 'SNL%' THEN 'cylindrical' WHEN cell_id LIKE 'MATR%' THEN 'cylindrical' WHEN cell_id LIKE 'ZN%' THEN 'coin' END AS form_factor FROM cells""")
def b04_material_metadata(spark, sf_dir):
    meta = spark.createDataFrame([("SNL", "cylindrical"), ("MATR", "cylindrical"), ("ZN-coin", "coin")], "prefix string, form_factor string")
    return clean.material_metadata(fx.cells(spark, sf_dir), meta).select(CELL, "form_factor")


@query("SELECT p_partkey, CASE WHEN p_size % 5 - 2 = 0 THEN 1 ELSE CAST(p_size % 5 - 2 AS DOUBLE) END AS span FROM part")
def b05_soc_span(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", parse.soc_span(F.lit(2.0), (F.col("p_size") % 5).cast("double")).alias("span"))


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, round(i * 1000, 4) AS i, round(t / 60, 4) AS t FROM readings")
def b06_convert_units(spark, sf_dir):
    return rounded(clean.convert_units(fx.readings(spark, sf_dir).select(*KEY, "i", "t"), {"i": 1000.0, "t": 1 / 60}), "i", "t")


@query("SELECT event_id, CAST((event_id % 40) * 3600 + (event_id % 60) * 60 + (event_id % 7) AS DOUBLE) + 0.5 AS s FROM events")
def b07_hms_to_seconds(spark, sf_dir):
    k = F.col("event_id")
    text = F.concat(F.lit("2024-01-01 "), (k % 40).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":"), (k % 7).cast("string"), F.lit(".5"))
    return fx.table(spark, sf_dir, "events").select("event_id", parse.hms_to_seconds(text).alias("s"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) END AS s FROM events")
def b08_timestamp_to_seconds(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("never")
    return fx.table(spark, sf_dir, "events").select("event_id", parse.timestamp_to_seconds(text).alias("s"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS x FROM events WHERE event_id % 5 <> 0")
def b09_coerce_numeric(spark, sf_dir):
    k = F.col("event_id")
    e = fx.table(spark, sf_dir, "events").select("event_id", F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "-").otherwise(k.cast("string")).alias("x"))
    return clean.coerce_numeric(e, ["x"], ["x"], dash_is_zero=True)


@query(f"WITH {fx.CELLS} SELECT cell_id FROM cells WHERE num % 4 <> 0 AND cell_id NOT LIKE '%LFP%'")
def b10_drop_cells(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select(CELL, "num")
    return clean.drop_cells(c, c.where("num % 4 = 0"), "LFP").select(CELL)


RULES_SQL = "rules AS (SELECT s_suppkey AS cell_id, 10 AS lo, 30 AS hi, CASE WHEN s_suppkey % 2 = 0 THEN '>' ELSE '<' END AS op, CASE WHEN s_suppkey % 2 = 0 THEN 1.05 ELSE 1.03 END AS threshold FROM supplier WHERE s_suppkey % 3 = 0)"


@query(f"""WITH {fx.CAPS}, {RULES_SQL} SELECT c.cell_id, count(*) AS left_over FROM caps c WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.cell_id = c.cell_id AND c.cycle_number BETWEEN lo AND hi
  AND CASE WHEN op = '>' THEN qd_max > threshold ELSE qd_max < threshold END) GROUP BY 1""")
def b11_drop_by_rules(spark, sf_dir):
    k = F.col("s_suppkey")
    rules = fx.table(spark, sf_dir, "supplier").where(k % 3 == 0).select(k.alias(CELL), F.lit(10).alias("lo"), F.lit(30).alias("hi"), F.when(k % 2 == 0, ">").otherwise("<").alias("op"), F.when(k % 2 == 0, 1.05).otherwise(1.03).alias("threshold"))
    kept, _ = clean.drop_by_rules(fx.caps(spark, sf_dir), rules)
    return kept.groupBy(CELL).agg(F.count(F.lit(1)).alias("left_over"))


@query(f"WITH {fx.CAPS} SELECT cell_id, cycle_number - CAST(CASE WHEN cell_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS cycle_number FROM caps WHERE cycle_number > CASE WHEN cell_id % 3 = 0 THEN 2 ELSE 0 END")
def b12_drop_formation(spark, sf_dir):
    c = fx.caps(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), (F.col(CELL) % 3).cast("string")))
    return clean.drop_formation(c, spark.createDataFrame([("d0", 2)], "dataset string, n int")).select(CELL, CYC)


@query(f"""WITH {fx.CAPS}, r AS (SELECT *, CASE WHEN cell_id % 100 = 7 THEN 4 WHEN cell_id % 10 = 7 THEN 1 WHEN cell_id % 3 = 0 THEN 2 ELSE 0 END AS n, cell_id % 10 <> 7 AS shift FROM caps)
  SELECT cell_id, cycle_number - CAST(CASE WHEN shift THEN n ELSE 0 END AS INTEGER) AS cycle_number FROM r WHERE cycle_number > n""")
def b12_drop_formation_by_cell(spark, sf_dir):
    """Rules of single cells, by the beginning of the name, go before those of the dataset."""
    name = F.concat((F.col(CELL) % 10).cast("string"), (F.floor(F.col(CELL) / 10) % 10).cast("string"), F.lit("_"), F.col(CELL).cast("string"))
    c = fx.caps(spark, sf_dir).withColumns({"dataset": F.concat(F.lit("d"), (F.col(CELL) % 3).cast("string")), "_id": F.col(CELL), CELL: name})
    rules = spark.createDataFrame([("7", 1, False), ("70", 4, False)], "prefix string, n int, shift boolean")
    return clean.drop_formation(c, spark.createDataFrame([("d0", 2)], "dataset string, n int"), rules).select(F.col("_id").alias(CELL), CYC)


@query(f"WITH {fx.CAPS} SELECT cell_id, CAST(dense_rank() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS INTEGER) AS cycle_number, round(qd_max, 6) AS qd_max FROM caps WHERE cycle_number % 4 <> 0")
def b13_renumber_cycles(spark, sf_dir):
    return rounded(clean.renumber_cycles(fx.caps(spark, sf_dir).where("cycle_number % 4 <> 0")), "qd_max", places=6)


@query(f"""WITH {fx.READINGS}, r AS (SELECT *, cycle_number % 3 + (idx % 2) AS raw_index FROM readings),
  s AS (SELECT *, coalesce(CAST(raw_index <> lag(raw_index) OVER w AS INTEGER), 0) AS step, first_value(raw_index) OVER w AS f FROM r WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number, idx))
  SELECT cell_id, cycle_number, idx, CAST(f + sum(step) OVER (PARTITION BY cell_id ORDER BY cycle_number, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unwrapped FROM s""")
def b14_unwrap_cycle_index(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select(*KEY, (F.col(CYC) % 3 + F.col("idx") % 2).alias("raw_index"))
    return clean.unwrap_cycle_index(r, [CYC, "idx"]).drop("raw_index")


@query(f"WITH {fx.READINGS} SELECT cell_id, floor(t / 86400) AS day, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, floor(t / 86400) ORDER BY event_id) AS n FROM readings) WHERE n = 1 GROUP BY 1, 2")
def b15_dedupe_readings(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select(CELL, F.floor(F.col("t") / 86400).cast("double").alias("day"), "event_id")
    return clean.dedupe_readings(r, "day", "event_id")


@query(f"""WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, first_value(CASE WHEN qc >= 0 AND qd >= 0 THEN qd END IGNORE NULLS) OVER w AS qd,
  first_value(CASE WHEN qc >= 0 AND qd >= 0 THEN qc END IGNORE NULLS) OVER w AS qc FROM readings WINDOW w AS (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def b16_mask_negative_and_bfill(spark, sf_dir):
    return clean.mask_negative_and_bfill(fx.readings(spark, sf_dir).select(*KEY, "qd", "qc"), ["qd", "qc"]).select(*KEY, "qd", "qc")


@query(f"WITH {fx.CAPS} SELECT cell_id, cycle_number FROM caps WHERE cycle_number <= least(40, cell_id % 60 + 1) + 1")
def b17_early_life_prefix(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(CELL), (F.col("s_suppkey") % 60 + 1).alias("eol"))
    return clean.early_life_prefix(fx.caps(spark, sf_dir), labels, 40).select(CELL, CYC)


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, CASE WHEN i >= 0 THEN 0 ELSE qd END AS qd, CASE WHEN i < 0 THEN 0 ELSE qc END AS qc FROM readings WHERE NOT (i > -0.001 AND i < 0)")
def b18_zero_inactive_capacity(spark, sf_dir):
    return clean.zero_inactive_capacity(fx.readings(spark, sf_dir)).select(*KEY, "qd", "qc")


@query(f"WITH {fx.READINGS}, n AS (SELECT cell_id, count(DISTINCT cycle_number) AS c FROM readings GROUP BY 1), k AS (SELECT r.*, count(*) OVER (PARTITION BY cell_id, cycle_number) AS m FROM readings r) SELECT k.cell_id, cycle_number, idx FROM k JOIN n USING (cell_id) WHERE cycle_number < c AND m >= 3")
def b19_drop_incomplete_cycles(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select(*KEY)
    return clean.drop_short_cycles(clean.drop_last_cycle(r), 3)


@query(f"WITH {fx.READINGS}, m AS (SELECT *, max(qd) OVER (PARTITION BY cell_id, cycle_number) AS q FROM readings) SELECT cell_id, cycle_number, idx FROM m WHERE q > 0.9 AND q < 1.14")
def b20_keep_cycles_by_capacity_range(spark, sf_dir):
    return clean.keep_cycles_by_capacity_range(fx.readings(spark, sf_dir).select(*KEY, "qd"), 0.9, 1.14).drop("qd")


@query(f"WITH {fx.READINGS}, f AS (SELECT cell_id, cycle_number FROM readings WHERE idx = 1 AND i > -0.5 AND i < 0.5) SELECT cell_id, cycle_number, idx FROM readings JOIN f USING (cell_id, cycle_number)")
def b21_keep_cycles_by_first_current(spark, sf_dir):
    return clean.keep_cycles_by_first_current(fx.readings(spark, sf_dir).select(*KEY, "i"), 0.0, 0.5).drop("i")


@query(f"WITH {fx.CAPS}, e AS (SELECT *, coalesce(min(cycle_number) FILTER (qd_max < 0.99) OVER w, max(cycle_number) OVER w) AS stop FROM caps WINDOW w AS (PARTITION BY cell_id)) SELECT cell_id, cycle_number FROM e WHERE cycle_number <= stop")
def b22_cap_at_problem_cycle(spark, sf_dir):
    c = fx.caps(spark, sf_dir).withColumn("efficiency", F.col("qd_max") + 0.01)
    return clean.cap_at_problem_cycle(c).select(CELL, CYC)


@query(f"""WITH {fx.CAPS}, s AS (SELECT cell_id, max(cycle_number) AS m FROM caps GROUP BY 1) SELECT coalesce(p.cell_id, c.cell_id) AS cell_id, count(*) AS n, CAST(max(cycle_number + coalesce(m, 0)) AS INTEGER) AS last
  FROM caps c LEFT JOIN s p ON c.cell_id % 4 = 1 AND p.cell_id = c.cell_id - 1 GROUP BY 1""")
def b23_splice_cells(spark, sf_dir):
    k = F.col("s_suppkey")
    pairs = fx.table(spark, sf_dir, "supplier").where(k % 4 == 1).select((k - 1).alias("head"), k.alias("tail"))
    return clean.splice_cells(fx.caps(spark, sf_dir), pairs).groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max(CYC).alias("last"))


@query(f"WITH {fx.CAPS} SELECT cell_id, CAST(cycle_number - CASE WHEN cell_id % 3 = 0 AND cycle_number > 7 THEN 1 ELSE 0 END AS INTEGER) AS cycle_number, round(qd_max, 6) AS qd_max FROM caps WHERE NOT (cell_id % 3 = 0 AND cycle_number = 7)")
def b24_skip_defect_cycle(spark, sf_dir):
    k = F.col("s_suppkey")
    d = fx.table(spark, sf_dir, "supplier").where(k % 3 == 0).select(k.alias(CELL), F.lit(7).alias("at"))
    return rounded(clean.skip_defect_cycle(fx.caps(spark, sf_dir), d), "qd_max", places=6)


@query(f"WITH {fx.READINGS}, m AS (SELECT cell_id, cycle_number, median(temp) AS m FROM readings GROUP BY 1, 2) SELECT cell_id, cycle_number, idx, round(coalesce(temp, m), 4) AS temp FROM readings JOIN m USING (cell_id, cycle_number)")
def b25_fill_with_cycle_median(spark, sf_dir):
    return rounded(clean.fill_with_cycle_median(fx.readings(spark, sf_dir).select(*KEY, "temp"), "temp"), "temp")


@query(f"WITH {fx.CELLS} SELECT cell_id, CASE WHEN cell_id LIKE 'MATR%' OR cell_id LIKE '%LFP%' THEN 0 ELSE 1 END AS chemistry FROM cells")
def b26_chemistry_flag(spark, sf_dir):
    return fx.cells(spark, sf_dir).select(CELL, parse.chemistry_flag(F.col(CELL)).alias("chemistry"))


@query(f"WITH {fx.HEALTH}, {fx.CAPS.split('soh FROM numbered)')[1].lstrip(', ')} SELECT cell_id, cycle_number, round(soh, 6) AS soh, round(qd_max, 6) AS qd_max FROM caps LEFT JOIN health USING (cell_id, cycle_number)")
def b27_attach_cycle_summary(spark, sf_dir):
    return rounded(clean.attach_cycle_summary(fx.caps(spark, sf_dir), fx.health(spark, sf_dir)), "soh", "qd_max", places=6)


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS INTEGER) AS place FROM part")
def b28_natural_order(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("b"), F.col("p_size").cast("string")))
    return placed(p.withColumn("key", parse.natural_key(F.col("name"))), ["key", "p_partkey"], "place").select("p_partkey", "place")


# --- C: time repair ----------------------------------------------------------------------------


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, round(t, 6) AS t FROM readings")
def c01_normalise_time_unit(spark, sf_dir):
    r = fx.readings(spark, sf_dir).select(*KEY, ((F.col("t") + 1e7) * 1e9).alias("t"))
    return rounded(timeaxis.normalise_time_unit(r).withColumn("t", F.col("t") - 1e7), "t", places=6)


@query(f"WITH {fx.FAULTY}, {FIXED} SELECT cell_id, cycle_number, idx, round(t, 6) AS t FROM fixed")
def c02_fix_time_resets(spark, sf_dir):
    return rounded(timeaxis.fix_time_resets(fx.faulty(spark, sf_dir)).select(*KEY, "t"), "t", places=6)


@query(f"""WITH {fx.READINGS}, s AS (SELECT cell_id, cycle_number, min(t) AS lo, arg_max(t, idx) AS hi FROM readings GROUP BY 1, 2),
  o AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s)
  SELECT cell_id, cycle_number, idx, round(t - lo + shift, 6) AS t FROM readings JOIN o USING (cell_id, cycle_number)""")
def c03_cumulate_time_across_cycles(spark, sf_dir):
    return rounded(timeaxis.cumulate_time_across_cycles(fx.readings(spark, sf_dir).select(*KEY, "t")), "t", places=6)


@query(f"""WITH {fx.FAULTY}, k AS (SELECT *, t - pt AS d, CASE WHEN pt IS NULL THEN NULL WHEN t = 0 OR (t < 0.5 * pt AND pt > 10) OR t < pt - 100 THEN 'reset' WHEN t - pt > 300 THEN 'gap' ELSE 'step' END AS kind
   FROM (SELECT *, lag(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS pt FROM faulty))
  SELECT cell_id, cycle_number, count_if(kind = 'reset') AS resets, count_if(kind = 'gap') AS gaps, coalesce(sum(idx) FILTER (kind = 'reset'), 0) AS reset_places, round(coalesce(sum(d) FILTER (kind = 'gap'), 0), 3) AS gap_seconds FROM k GROUP BY 1, 2""")
def c04_reset_report(spark, sf_dir):
    r = timeaxis.reset_report(fx.faulty(spark, sf_dir))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    out = r.select(CELL, CYC, "resets", "gaps", total("reset_at", lambda x: x).cast("long").alias("reset_places"), total("gap_list", lambda x: x["seconds"]).alias("gap_seconds"))
    return rounded(out, "gap_seconds", places=3)


@query(f"""WITH {fx.FAULTY}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS d FROM faulty), b AS (SELECT cell_id, count(DISTINCT cycle_number) AS bad FROM d WHERE d < 0 OR abs(d) > 7200 GROUP BY 1)
  SELECT cell_id, coalesce(bad, 0) > 0 AS has_issues, count(DISTINCT cycle_number) AS cycles, coalesce(bad, 0) AS bad_cycles FROM faulty LEFT JOIN b USING (cell_id) GROUP BY 1, bad""")
def c05_validate_time(spark, sf_dir):
    return timeaxis.validate_time(fx.faulty(spark, sf_dir))


@query(f"WITH {fx.READINGS} SELECT cell_id, count(*) AS n, round(arg_max(t, cycle_number * 1000000 + idx), 4) AS last FROM readings GROUP BY 1")
def c06_cumulative_time_array(spark, sf_dir):
    a = timeaxis.cumulative_time_array(fx.readings(spark, sf_dir))
    ends = a.groupBy(CELL).agg(F.sum(F.size("times")).alias("n"), F.max_by(F.element_at("times", -1), "chunk").alias("last"))
    return rounded(ends, "last")


#: Readings of a cell numbered from 1, for recursive folds.
NUMBERED = "x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) AS n FROM faulty)"


@query(f"""WITH RECURSIVE {fx.FAULTY}, {NUMBERED},
  r AS (SELECT cell_id, n, t AS t_strict FROM x WHERE n = 1
    UNION ALL SELECT x.cell_id, x.n, CASE WHEN x.t > r.t_strict THEN x.t ELSE r.t_strict + CAST(1e-6 AS DOUBLE) END FROM r JOIN x ON x.cell_id = r.cell_id AND x.n = r.n + 1)
  SELECT cell_id, cycle_number, idx, t, round(t_strict, 9) AS t_strict FROM x JOIN r USING (cell_id, n)""")
def c07_strictly_increasing_time(spark, sf_dir):
    return rounded(timeaxis.strictly_increasing_time(fx.faulty(spark, sf_dir).select(*KEY, "t")), "t_strict", places=9)


@query(f"""WITH RECURSIVE {fx.FAULTY}, {NUMBERED},
  r AS (SELECT cell_id, n, t AS last, true AS good FROM x WHERE n = 1
    UNION ALL SELECT x.cell_id, x.n, CASE WHEN x.t - r.last > 1e4 THEN r.last ELSE x.t END, NOT x.t - r.last > 1e4 FROM r JOIN x ON x.cell_id = r.cell_id AND x.n = r.n + 1)
  SELECT cell_id, cycle_number, idx, t FROM x JOIN r USING (cell_id, n) WHERE good""")
def c08_drop_time_spikes(spark, sf_dir):
    return timeaxis.drop_time_spikes(fx.faulty(spark, sf_dir).select(*KEY, "t"), 1e4)


@query(f"""WITH {fx.READINGS}, d AS (SELECT *, CASE WHEN idx = 1 THEN 0 ELSE greatest(coalesce(i, 0), 0) END AS g FROM readings)
  SELECT cell_id, cycle_number, idx, round(sum(g) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS elapsed FROM d""")
def c09_build_elapsed_time(spark, sf_dir):
    return rounded(timeaxis.build_elapsed_time(fx.readings(spark, sf_dir).select(*KEY, "i"), step="i").drop("i"), "elapsed")


@query(f"""WITH {fx.FAULTY} SELECT cell_id, cycle_number, idx, round(max(t - f) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS axis
  FROM (SELECT *, first_value(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS f FROM faulty)""")
def c10_monotone_time_axis(spark, sf_dir):
    return rounded(timeaxis.monotone_time_axis(fx.faulty(spark, sf_dir)).select(*KEY, "axis"), "axis", places=6)


@query(f"WITH {fx.FAULTY}, n AS (SELECT *, lead(round(t, 6)) OVER (PARTITION BY cell_id ORDER BY cycle_number, idx) AS nt FROM faulty) SELECT cell_id, cycle_number, idx FROM n WHERE nt < round(t, 6)")
def c11_time_descents(spark, sf_dir):
    return timeaxis.time_descents(fx.faulty(spark, sf_dir)).select(*KEY)


# --- D: integration and segmentation -----------------------------------------------------------------


@query(f"WITH {fx.FAULTY}, {FIXED}, {COULOMB} SELECT cell_id, cycle_number, idx, round(qc2, 9) AS qc, round(qd2, 9) AS qd FROM counted")
def d01_coulomb_count(spark, sf_dir):
    r = segment.coulomb_count(timeaxis.fix_time_resets(fx.faulty(spark, sf_dir)))
    return rounded(r.select(*KEY, "qc", "qd"), "qc", "qd", places=9)


@query(f"""WITH RECURSIVE {fx.READINGS}, x AS MATERIALIZED (SELECT cell_id, cycle_number, idx, i, t, lag(t) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS pt FROM readings),
  r AS (SELECT cell_id, cycle_number, idx, CAST(0 AS DOUBLE) AS qc, CAST(0 AS DOUBLE) AS qd FROM x WHERE idx = 1
    UNION ALL SELECT x.cell_id, x.cycle_number, x.idx, CASE WHEN c < 2 THEN c ELSE 0 END, CASE WHEN d < 2 THEN d ELSE 0 END
    FROM r JOIN x ON x.cell_id = r.cell_id AND x.cycle_number = r.cycle_number AND x.idx = r.idx + 1,
      LATERAL (SELECT CASE WHEN x.i > 0 THEN r.qc + x.i * (x.t - x.pt) / 3600 ELSE r.qc END AS c, CASE WHEN x.i < 0 THEN r.qd - x.i * (x.t - x.pt) / 3600 ELSE r.qd END AS d) s)
  SELECT x.cell_id, x.cycle_number, x.idx, i, t, round(qc, 6) AS qc, round(qd, 6) AS qd FROM x JOIN r USING (cell_id, cycle_number, idx)""")
def d02_coulomb_count_capped(spark, sf_dir):
    return rounded(segment.coulomb_count_capped(fx.readings(spark, sf_dir).select(*KEY, "i", "t")), "qc", "qd", places=6)


@query(f"""WITH {fx.READINGS}, a AS (SELECT *, CASE WHEN i > 0 THEN 1 WHEN i < 0 THEN -1 ELSE 0 END AS s, greatest(coalesce(t - lag(t) OVER w, 0), 0) AS dt FROM readings WINDOW w AS (PARTITION BY cell_id, cycle_number ORDER BY idx)),
  b AS (SELECT *, coalesce(CAST(s <> lag(s) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS INTEGER), 1) AS nw FROM a),
  c AS (SELECT *, sum(nw) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM b),
  d AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 0.5 * (coalesce(lag(abs(i)) OVER (PARTITION BY cell_id, cycle_number, run ORDER BY idx), 0) + abs(i)) * dt / 3600 END AS part FROM c)
  SELECT cell_id, cycle_number, idx, round(sum(part) OVER (PARTITION BY cell_id, cycle_number, run ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS q_run FROM d""")
def d03_trapezoid_by_run(spark, sf_dir):
    return rounded(segment.trapezoid_by_run(fx.readings(spark, sf_dir).select(*KEY, "i", "t")).select(*KEY, "q_run"), "q_run")


@query(f"""WITH {fx.READINGS}, e AS (SELECT *, min(idx) FILTER (i >= 0.01) OVER w AS c0, max(idx) FILTER (i >= 0.01) OVER w AS c1, min(idx) FILTER (i <= -0.01) OVER w AS d0, max(idx) FILTER (i <= -0.01) OVER w AS d1 FROM readings WINDOW w AS (PARTITION BY cell_id, cycle_number))
  SELECT cell_id, cycle_number, idx, CASE WHEN coalesce(idx BETWEEN c0 AND c1, false) OR abs(i) < 0.01 THEN 0 ELSE v END AS qd, CASE WHEN coalesce(idx BETWEEN d0 AND d1, false) OR abs(i) < 0.01 THEN 0 ELSE v END AS qc FROM e""")
def d04_split_capacity_column(spark, sf_dir):
    return segment.split_capacity_column(fx.readings(spark, sf_dir).drop("qc", "qd"), 1.0, "v").select(*KEY, "qd", "qc")


STEPS = "st AS (SELECT *, CASE WHEN i > 0 THEN 'charge' WHEN i < 0 THEN 'discharge' ELSE 'rest' END AS kind, (idx - 1) // 4 AS step FROM readings)"


def _steps(spark, sf_dir):
    kind = F.when(F.col("i") > 0, "charge").when(F.col("i") < 0, "discharge").otherwise("rest")
    return fx.readings(spark, sf_dir).withColumns({"kind": kind, "step": F.floor((F.col("idx") - 1) / 4).cast("int"), "raw": F.col("v"), "raw_qd": F.col("qd")})


@query(f"""WITH {fx.READINGS}, {STEPS}, g AS (SELECT cell_id, cycle_number, step, min(idx) AS a, arg_max(v, idx) AS l FROM st GROUP BY 1, 2, 3 HAVING bool_or(kind = 'charge')),
  h AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY cell_id, cycle_number ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM g)
  SELECT cell_id, cycle_number, idx, round(coalesce(v + carry, 0), 4) AS qc, CASE WHEN kind = 'discharge' THEN qd ELSE 0 END AS qd FROM st LEFT JOIN h USING (cell_id, cycle_number, step)""")
def d05_accumulate_step_capacity(spark, sf_dir):
    return rounded(segment.accumulate_step_capacity(_steps(spark, sf_dir)).select(*KEY, "qc", "qd"), "qc")


@query(f"WITH {fx.READINGS} SELECT cell_id, cycle_number, idx, round(v - qd, 6) AS qc FROM readings")
def d06_charge_from_total(spark, sf_dir):
    return rounded(segment.charge_from_total(fx.readings(spark, sf_dir).withColumn("total", F.col("v"))).select(*KEY, "qc"), "qc", places=6)


STAGE = "staged AS (SELECT *, CASE WHEN abs(i) <= 0.02 THEN 'rest' WHEN i > 0 THEN 'charge' ELSE 'discharge' END AS stage FROM readings)"


@query(f"WITH {fx.READINGS}, {STAGE} SELECT stage, count(*) AS n FROM staged GROUP BY 1")
def d07_classify_stage(spark, sf_dir):
    return segment.classify_stage(fx.readings(spark, sf_dir), 1.0).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.READINGS}, {STAGE}, k AS (SELECT * FROM (SELECT *, lag(stage) OVER (PARTITION BY cell_id, cycle_number ORDER BY idx) AS p FROM staged) WHERE p IS NULL OR p <> stage)
  SELECT cell_id, cycle_number, string_agg(stage, ',' ORDER BY idx) AS stages, count_if(stage = 'charge') > 1 OR count_if(stage = 'discharge') > 1 AS odd FROM k GROUP BY 1, 2""")
def d08_compress_stages(spark, sf_dir):
    s = segment.compress_stages(segment.classify_stage(fx.readings(spark, sf_dir), 1.0))
    return s.withColumn("stages", F.array_join("stages", ","))


@query()
def d09_find_cycle_ends(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    placed = r.withColumn("n", F.row_number().over(Window.partitionBy(CELL).orderBy(CYC, "idx")) - 1)
    return segment.find_cycle_ends(placed.select(CELL, "n", "i"), lag=2, tolerance=0.1, quiet=5)


@query(f"""WITH {fx.READINGS}, r AS (SELECT *, CASE WHEN cycle_number % 3 = 0 THEN cycle_number END AS rpt FROM readings),
  a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND rpt IS NOT DISTINCT FROM lag(rpt) OVER w THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number, idx)),
  b AS (SELECT *, sum(nw) OVER (PARTITION BY cell_id ORDER BY cycle_number, idx ROWS UNBOUNDED PRECEDING) AS seg FROM a)
  SELECT cell_id, seg AS segment, CASE WHEN rpt IS NULL THEN 'Cycling' ELSE 'RPT' END AS kind, count(*) AS n FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def d10_segment_rpt_runs(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn("rpt", F.when(F.col(CYC) % 3 == 0, F.col(CYC)))
    return segment.segment_rpt_runs(r).where("segment is not null").groupBy(CELL, "segment", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def d11_split_full_cycles(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn("i", F.when(F.floor((F.col("idx") - 1) / 6) % 2 == 0, F.abs("i")).otherwise(-F.abs("i")))
    return segment.split_full_cycles(r.select(*KEY, "i", "t"))


@query(f"""WITH {fx.READINGS}, r AS (SELECT *, CASE WHEN cycle_number % 3 = 0 THEN cycle_number END AS rpt, greatest(-i, 0) * greatest(coalesce(t - lag(t) OVER w, 0), 0) / 3600 AS flow, lag(cycle_number) OVER w AS pc FROM readings WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number, idx)),
  s AS (SELECT *, coalesce(sum(flow) OVER (PARTITION BY cell_id ORDER BY cycle_number, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS th, count(*) OVER (PARTITION BY cell_id, cycle_number) AS m FROM r)
  SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS INTEGER) AS rpt_order, rpt, round(th, 4) AS throughput FROM s WHERE rpt IS NOT NULL AND idx = 1 AND m >= 2""")
def d12_rpt_throughput(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn("rpt", F.when(F.col(CYC) % 3 == 0, F.col(CYC)))
    return rounded(segment.rpt_throughput(segment.segment_rpt_runs(r)).select(CELL, "rpt_order", "rpt", "throughput"), "throughput")


@query(f"""WITH {fx.READINGS}, d AS (SELECT cell_id, cycle_number, CASE WHEN event_type = 'error' AND cycle_number = 2 THEN 'Capacity Test' ELSE event_type END AS description, min(idx) AS a FROM readings GROUP BY 1, 2, 3)
  SELECT cell_id, cycle_number, string_agg(description, ' | ' ORDER BY a) AS step_description, CASE WHEN bool_or(description = 'Capacity Test') THEN 'RPT' ELSE 'Cycling' END AS attribute FROM d GROUP BY 1, 2""")
def d13_cycle_attribute(spark, sf_dir):
    d = F.when((F.col("event_type") == "error") & (F.col(CYC) == 2), "Capacity Test").otherwise(F.col("event_type"))
    return segment.cycle_attribute(fx.readings(spark, sf_dir).withColumn("description", d))


PHASES = "ph AS (SELECT * FROM (SELECT *, CASE WHEN idx < e THEN 'charge' WHEN idx >= e AND abs(i) > 0.01 THEN 'discharge' END AS phase FROM (SELECT *, max(idx) FILTER (i >= 0.01) OVER (PARTITION BY cell_id, cycle_number) AS e FROM readings)) WHERE phase IS NOT NULL)"


@query(f"WITH {fx.READINGS}, {PHASES} SELECT cell_id, cycle_number, phase, count(*) AS n, min(idx) AS low, max(idx) AS high FROM ph GROUP BY 1, 2, 3")
def d14_phase_slices(spark, sf_dir):
    p = segment.phase_slices(fx.readings(spark, sf_dir), 1.0)
    return p.groupBy(CELL, CYC, "phase").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))


@query(f"""WITH {fx.READINGS}, m AS (SELECT *, qd / 1.1 AS value, row_number() OVER w AS n, coalesce(lead(qd / 1.1) OVER w > qd / 1.1, false) AS up FROM readings WHERE i > 0 WINDOW w AS (PARTITION BY cell_id, cycle_number ORDER BY idx)),
  b AS (SELECT *, min(n) FILTER (up AND value < 0.3) OVER w AS s, max(n) FILTER (up) OVER w + 1 AS e FROM m WINDOW w AS (PARTITION BY cell_id, cycle_number)) SELECT cell_id, cycle_number, idx FROM b WHERE n BETWEEN s AND e""")
def d15_masked_trim(spark, sf_dir):
    return segment.masked_trim(fx.readings(spark, sf_dir), 1.1, "qd", F.col("i") > 0, 0.3).select(*KEY)


@query(f"""WITH RECURSIVE {fx.CAPS}, x AS MATERIALIZED (SELECT *, cycle_number * CAST(10 AS DOUBLE) AS start, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS n FROM caps),
  p AS MATERIALIZED (SELECT cell_id, start + 5 AS start, row_number() OVER (PARTITION BY cell_id ORDER BY start) AS k FROM x WHERE cycle_number % 9 = 0),
  r AS (SELECT x.cell_id, x.n, CAST(1 + CAST(coalesce(p.start < x.start, false) AS INTEGER) AS BIGINT) AS k, NOT coalesce(p.start < x.start, false) AS keep FROM x LEFT JOIN p ON p.cell_id = x.cell_id AND p.k = 1 WHERE n = 1
    UNION ALL SELECT x.cell_id, x.n, r.k + CAST(coalesce(p.start < x.start, false) AS INTEGER), NOT coalesce(p.start < x.start, false)
    FROM r JOIN x ON x.cell_id = r.cell_id AND x.n = r.n + 1 LEFT JOIN p ON p.cell_id = r.cell_id AND p.k = r.k)
  SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS INTEGER) AS cycle_number, round(qd_max, 9) AS qd_max, start FROM x JOIN r USING (cell_id, n) WHERE keep""")
def d16_drop_cycle_after_rpt(spark, sf_dir):
    c = fx.caps(spark, sf_dir).withColumn("start", F.col(CYC) * 10.0)
    rpt = c.where("cycle_number % 9 = 0").select(CELL, (F.col("start") + 5).alias("start"))
    return rounded(segment.drop_cycle_after_rpt(c, rpt), "qd_max", places=9)


# --- E: outliers and imputation ------------------------------------------------------------------------


@query(f"""WITH {fx.CAPS}, w AS (SELECT *, list(qd_max) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM caps),
  o AS (SELECT cell_id, cycle_number, qd_max, abs(qd_max - list_sort(list_concat(near, list_transform(range(21 - len(near)), lambda x: CAST(0 AS DOUBLE))))[11]) AS d FROM w),
  m AS (SELECT *, median(d) OVER (PARTITION BY cell_id) AS m FROM o)
  SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cycle_number) AS INTEGER) AS cycle_number, round(qd_max, 6) AS qd_max FROM m WHERE d < 3 * m AND qd_max > 0.1""")
def e01_median_filter_outliers(spark, sf_dir):
    return rounded(clean.median_filter_outliers(fx.caps(spark, sf_dir)), "qd_max", places=6)


def _shift_sql(shifts: int, hampel: bool) -> str:
    d = ", ".join(f"least(coalesce(abs(qd_max - lag(qd_max, {s}) OVER w), 'inf'::DOUBLE), coalesce(abs(qd_max - lead(qd_max, {s}) OVER w), 'inf'::DOUBLE)) AS d{s}" for s in range(1, shifts + 1))
    if hampel:
        m = ", ".join(f"median(d{s}) OVER (PARTITION BY cell_id) AS m{s}" for s in range(1, shifts + 1))
        a = ", ".join(f"abs(d{s} - m{s}) AS a{s}" for s in range(1, shifts + 1))
        b = ", ".join(f"median(a{s}) OVER (PARTITION BY cell_id) AS b{s}" for s in range(1, shifts + 1))
        hit = " OR ".join(f"coalesce(a{s} > 3 * b{s}, false)" for s in range(1, shifts + 1))
        return f"d AS (SELECT *, {d} FROM caps WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)), m AS (SELECT *, {m} FROM d), a AS (SELECT *, {a} FROM m), b AS (SELECT *, {b} FROM a) SELECT cell_id, cycle_number, {hit} AS excluded FROM b"
    m = ", ".join(f"median(CASE WHEN d{s} > 0 AND d{s} < 'inf'::DOUBLE THEN d{s} END) OVER (PARTITION BY cell_id) AS m{s}" for s in range(1, shifts + 1))
    hit = " OR ".join(f"coalesce(d{s} > 10 * m{s}, false)" for s in range(1, shifts + 1))
    return f"d AS (SELECT *, {d} FROM caps WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)), m AS (SELECT *, {m} FROM d) SELECT cell_id, cycle_number, {hit} AS excluded FROM m"


@query(f"WITH {fx.CAPS}, {_shift_sql(2, False)}")
def e02_shift_outliers(spark, sf_dir):
    return clean.shift_outliers(fx.caps(spark, sf_dir)).select(CELL, CYC, "excluded")


@query(f"WITH {fx.CAPS}, {_shift_sql(3, True)}")
def e03_hampel_shift_outliers(spark, sf_dir):
    return clean.hampel_shift_outliers(fx.caps(spark, sf_dir), 3).select(CELL, CYC, "excluded")


@query(f"""WITH {fx.CAPS}, w AS (SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY cell_id) AS c, median(qd_max) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, median(qd_max) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a
  FROM caps WINDOW o AS (PARTITION BY cell_id ORDER BY cycle_number)) SELECT cell_id, cycle_number FROM w WHERE NOT (n > 5 AND n <= c - 5 AND abs(qd_max - b) > 0.05 AND abs(qd_max - a) > 0.05)""")
def e04_two_sided_median_outliers(spark, sf_dir):
    return clean.two_sided_median_outliers(fx.caps(spark, sf_dir)).select(CELL, CYC)


GAPPY = "gappy AS (SELECT * FROM caps WHERE (cell_id + cycle_number) % 11 <> 0)"


def _gappy(spark, sf_dir):
    return fx.caps(spark, sf_dir).where((F.col(CELL) + F.col(CYC)) % 11 != 0)


@query(f"WITH {fx.CAPS}, {GAPPY}, m AS (SELECT cell_id, max(cycle_number) AS m FROM gappy GROUP BY 1), a AS (SELECT cell_id, CAST(unnest(range(1, m + 1)) AS INTEGER) AS cycle_number FROM m) SELECT cell_id, cycle_number FROM a ANTI JOIN gappy USING (cell_id, cycle_number)")
def e05_missing_cycles(spark, sf_dir):
    return clean.missing_cycles(_gappy(spark, sf_dir))


@query(f"""WITH {fx.CAPS}, {GAPPY}, m AS (SELECT cell_id, max(cycle_number) AS m FROM gappy GROUP BY 1), a AS (SELECT cell_id, CAST(unnest(range(1, m + 1)) AS INTEGER) AS cycle_number FROM m),
  j AS (SELECT a.cell_id, a.cycle_number, CASE WHEN g.qd_max IS NOT NULL AND NOT (a.cycle_number % 13 = 0) THEN a.cycle_number END AS good FROM a LEFT JOIN gappy g USING (cell_id, cycle_number)),
  s AS (SELECT cell_id, cycle_number AS t, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS UNBOUNDED PRECEDING), first_value(good IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS src FROM j)
  SELECT s.cell_id, t AS cycle_number, round(qd_max, 6) AS qd_max FROM s JOIN gappy g ON g.cell_id = s.cell_id AND g.cycle_number = src""")
def e06_impute_bad_cycles(spark, sf_dir):
    c = _gappy(spark, sf_dir)
    bad = c.where("cycle_number % 13 = 0").select(CELL, CYC).unionByName(clean.missing_cycles(c))
    return rounded(clean.impute_bad_cycles(c, bad), "qd_max", places=6)


@query(f"""WITH {fx.READINGS}, m AS (SELECT cell_id, cycle_number, coalesce(abs(avg(i) FILTER (i < 0) + 2.4) <= 0.3, false) AS odd FROM readings GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN NOT odd THEN cycle_number END AS good FROM m),
  n AS (SELECT *, last_value(good IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS UNBOUNDED PRECEDING) AS b, first_value(good IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g),
  s AS (SELECT *, coalesce(CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN cycle_number - b <= a - cycle_number THEN b ELSE a END, cycle_number) AS src FROM n)
  SELECT s.cell_id, s.cycle_number, s.cycle_number <> src AS replaced, count(*) AS n FROM s JOIN readings r ON r.cell_id = s.cell_id AND r.cycle_number = src GROUP BY 1, 2, 3""")
def e07_replace_diagnostic_cycles(spark, sf_dir):
    r = clean.replace_diagnostic_cycles(fx.readings(spark, sf_dir), target=-2.4, tolerance=0.3)
    return r.groupBy(CELL, CYC, "replaced").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.CELLS} SELECT cell_id FROM cells WHERE NOT (cell_id LIKE '%20-80%' AND stored > 2.304)")
def e08_drop_half_cycles(spark, sf_dir):
    return clean.drop_half_cycles(fx.cells(spark, sf_dir).withColumn("qd_max", F.col("stored")), 2.304).select(CELL)

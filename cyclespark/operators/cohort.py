"""Splits, labels, ageing conditions and overviews (survey group H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.parse import name_prefix
from cyclespark.functions.windows import placed


def assign_split(cells: DataFrame, splits: DataFrame, dataset: str, seed: int, split: str) -> DataFrame:
    """Cells of one named split."""
    wanted = splits.where((F.col("dataset") == dataset) & (F.col("seed") == seed) & (F.col("split") == split))
    return cells.join(wanted.select("cell_id").distinct(), "cell_id", "left_semi")


def mix_splits(splits: DataFrame, members: list[str], name: str) -> DataFrame:
    """The union of the members' splits under one name."""
    return splits.where(F.col("dataset").isin(members)).withColumn("dataset", F.lit(name)).distinct()


def random_split(ids: DataFrame, column: str, train: float = 0.6, test: float = 0.2, seed: int = 0) -> DataFrame:
    """split by hash order with exact counts: int(train n), int(test n), the rest val.

    Ranks come from counts of 1024 hash ranges and places inside them, so no task orders all ids.
    """
    rows = ids.select(column).distinct().withColumn("_h", F.xxhash64(F.col(column).cast("string"), F.lit(seed)))
    rows = rows.withColumn("_b", F.floor(F.col("_h") / 2.0**54).cast("int"))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 1025 rows
    w = Window.orderBy("_b")
    sizes = sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", column)) - 1
    ranked = rows.withColumn("_p", place).join(F.broadcast(sizes.drop("_n")), "_b").withColumn("_p", F.col("_p") + F.col("_before"))
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * test)
    return ranked.select(column, F.when(F.col("_p") < a, "train").when(F.col("_p") < a + b, "test").otherwise("val").alias("split"))


def attach_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join by name; Tongji names differ in ``--`` and ``-#``."""
    name = F.when(F.col("cell_id").startswith("Tongji"), F.replace(F.col("cell_id"), F.lit("--"), F.lit("-#"))).otherwise(F.col("cell_id"))
    l_name = F.when(F.col("cell_id").startswith("Tongji"), F.replace(F.col("cell_id"), F.lit("--"), F.lit("-#"))).otherwise(F.col("cell_id"))
    known = labels.where("eol is not null").select(l_name.alias("_name"), "eol")
    return cells.withColumn("_name", name).join(known, "_name").drop("_name")


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row a cell from two directories; the first one's wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("cell_id").orderBy("_o")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_o")


def matching_rules(names: DataFrame, rules: DataFrame, name: str = "cell_id") -> DataFrame:
    """(name, ord, id) of each rule that a name of ``names`` (name, prefix) obeys.

    ``rules``: ord, prefix, id, clauses (array of arrays of substrings: of each inner one at least one must occur) and
    excluded (array of substrings: none may occur); nulls and empty arrays ask for nothing. Works like an inverted index: each distinct substring of
    a prefix is looked for once in a name, what occurs is joined to the clauses that list it, and the clauses met are counted.
    """
    parts = rules.select("ord", "prefix", "id", F.coalesce("clauses", F.array()).alias("clauses"), F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"))
    asked = F.concat(F.col("clauses"), F.array(F.array(F.lit(""))))  # the last clause is met by every name
    met = parts.select("ord", "prefix", F.posexplode(asked).alias("clause", "any")).select("ord", "prefix", "clause", F.explode("any").alias("part"))
    barred = parts.select("ord", "prefix", F.lit(-1).alias("clause"), F.explode("excluded").alias("part"))
    postings = met.unionByName(barred).distinct()
    occurs = names.select(name, "prefix").distinct().join(postings.select("prefix", "part").distinct(), "prefix").where(F.col(name).contains(F.col("part")))
    hits = occurs.join(postings, ["prefix", "part"]).groupBy(name, "prefix", "ord")
    counted = hits.agg(F.count_distinct(F.when(F.col("clause") >= 0, F.col("clause"))).alias("_met"), F.bool_or(F.col("clause") < 0).alias("_barred"))
    wanted = parts.select("ord", "prefix", "id", F.size(asked).alias("_all"))
    return counted.join(wanted, ["ord", "prefix"]).where(~F.col("_barred") & (F.col("_met") == F.col("_all"))).select(name, "ord", "id")


def ageing_condition(cells: DataFrame, rules: DataFrame, first_own_id: int = 629, own_prefix: str = "ZN-coin") -> DataFrame:
    """condition by the first rule, in the order of ord, that a cell's name obeys.

    ``rules``: ord, prefix, id and either pattern, one substring, or clauses and excluded as in ``matching_rules``. Cells of
    ``own_prefix`` get an id each, in order of their names, from ``first_own_id``.
    """
    named = cells.withColumn("prefix", name_prefix(F.col("cell_id")))
    if "clauses" not in rules.columns:
        rules = rules.withColumn("clauses", F.array(F.array("pattern")))
    if "excluded" not in rules.columns:
        rules = rules.withColumn("excluded", F.lit(None).cast("array<string>"))
    best = matching_rules(named, rules).groupBy("cell_id").agg(F.min_by("id", "ord").alias("id"))
    own = named.where(F.col("prefix") == own_prefix).select("cell_id").distinct()
    own = placed(own, ["cell_id"], "own").withColumn("own", F.col("own") - 1 + first_own_id)
    out = named.join(best, "cell_id", "left").join(own, "cell_id", "left")
    return out.withColumn("condition", F.coalesce("own", "id").cast("long")).drop("id", "own")


def dense_relabel(df: DataFrame, column: str) -> DataFrame:
    """dense: the place of the value among the sorted distinct ones, from 1."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(placed(values, [column], "dense"), column, "left")


def seen_unseen(conditions: DataFrame, splits: DataFrame) -> DataFrame:
    """Test cells with seen: whether their condition occurs in train or val."""
    both = splits.join(conditions.select("cell_id", "condition"), "cell_id")
    known = both.where(F.col("split") != "test").select("dataset", "condition").distinct().withColumn("_k", F.lit(True))
    test = both.where(F.col("split") == "test").join(known, ["dataset", "condition"], "left")
    return test.select("dataset", "cell_id", "condition", F.coalesce("_k", F.lit(False)).alias("seen"))


def dataset_overview(labels: DataFrame, conditions: DataFrame, marks: DataFrame, least: int = 100) -> DataFrame:
    """Per dataset: cells of life over ``least``, distinct conditions, seen and unseen test cells."""
    cells = labels.where(F.col("eol") > least).join(conditions.select("cell_id", "dataset", "condition"), "cell_id")
    cells = cells.join(marks.select("cell_id", "seen"), "cell_id", "left")
    return cells.groupBy("dataset").agg(
        F.count_distinct("cell_id").alias("cells"), F.count_distinct("condition").alias("conditions"), F.count_if("seen").alias("seen"), F.count_if(~F.col("seen")).alias("unseen")
    )


def resample_to_size(target: DataFrame, source: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """As many rows as ``source`` has, drawn from ``target`` with replacement by hash.

    A draw picks one of the target's hash slots and a place in it, so neither side is
    collected: slots hold a bounded share of the rows.
    """
    slots = 256
    t = target.withColumn("_s", F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(slots)))
    t = t.withColumn("_p", F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64(column), column)) - 1)
    sizes = t.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))  # at most `slots` rows
    n = target.count()
    bounds = sizes.withColumn("_to", F.sum("_n").over(Window.orderBy("_s"))).withColumn("_from", F.col("_to") - F.col("_n"))
    draws = target.sparkSession.range(source.count()).withColumn("_r", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(n, 1))))
    placed = draws.join(F.broadcast(bounds), (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))).select(F.col("id").alias("draw"), "_s", (F.col("_r") - F.col("_from")).alias("_p"))
    return placed.join(t, ["_s", "_p"]).drop("_s", "_p")


def chemical_systems(cells: DataFrame) -> DataFrame:
    """Distinct (cathode, anode, electrolyte) with the datasets that use them."""
    return cells.groupBy("cathode", "anode", "electrolyte").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))


def factor_tables(cells: DataFrame, columns: list[str]) -> DataFrame:
    """factor, value and the datasets where it occurs."""
    rows = cells.unpivot(["dataset"], columns, "factor", "value")
    return rows.groupBy("factor", "value").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))


def split_integrity(splits: DataFrame, labels: DataFrame, conditions: DataFrame) -> DataFrame:
    """Problems: a cell in two splits of one dataset and seed, or without label or condition."""
    two = splits.groupBy("dataset", "seed", "cell_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("dataset", "seed", "cell_id", F.lit("two_splits").alias("problem"))
    base = splits.select("dataset", "seed", "cell_id").distinct()
    known = labels.where("eol is not null").select("cell_id")
    no_label = base.join(known, "cell_id", "left_anti").select("dataset", "seed", "cell_id", F.lit("no_label").alias("problem"))
    no_condition = base.join(conditions.where("condition is not null").select("cell_id"), "cell_id", "left_anti").select("dataset", "seed", "cell_id", F.lit("no_condition").alias("problem"))
    return two.unionByName(no_label).unionByName(no_condition)


def filter_eval_domain(labels: DataFrame, target: str, rules: dict[str, list[str]]) -> DataFrame:
    """Labels that count for ``target``: those whose file has no excluded word."""
    out = labels
    for word in rules.get(target, []):
        out = out.where(~F.col("file").contains(word))
    return out

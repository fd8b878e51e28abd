"""Exact quantiles of groups of any size: small groups are sorted, large ones go by distributed selection.

For a large group a double is read as a whole number of the same order. The numbers of a group are counted by their
highest bits, the prefix that holds a wanted rank is kept, and the next bits are counted inside it, until
every kept prefix stands for one value. Tasks hold counters, never the values of a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.sources.shared import scratch

#: Bits a round: a group has at most 2^BITS counters in a task.
BITS = 16
#: Groups of at most so many values are sorted; so are those of kept prefixes once none stands for more.
FEW = 20_000


def ordered_bits(x: Column) -> Column:
    """A long in the order of doubles: the bits of the value, mirrored for negative ones; NaN comes last, -0.0 is 0.0."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    exponent = guess - F.when(F.pow(F.lit(2.0), guess) > a, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    fraction = (a / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + fraction.cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(a == float("inf"), F.lit(0x7FF << 52)).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(F.isnan(x), F.lit((0x7FF << 52) + 1)).when(x < 0, -bits).otherwise(bits)


def group_quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """A row a group of ``df`` with a column for each of ``wanted``, interpolated between neighbours as ``percentile`` does.

    Null values don't count; a group without others gets nulls; null keys form a group. ``df`` is read to count the groups and
    to sort those of at most ``FEW`` values. If there are larger ones it is read once more for each of their rounds, of which there are
    two to four, so callers write a ``df`` that is dear to compute. What goes from round to round has a row or two a group and quantile.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "quantiles")
    names = [f"_k{j}" for j in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], value.cast("double").alias("_v"))
    large = rows.groupBy(*names).agg(F.count("_v").alias("_m")).where(F.col("_m") > FEW).select(*[F.col(n).alias(f"{n}_") for n in names])
    large.write.parquet(f"{path}/large")  # a row for each FEW rows of the table at most
    large = spark.read.schema(large.schema).parquet(f"{path}/large")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    if large.isEmpty():
        return _sorted_quantiles(rows, names, wanted, keys)
    small = _sorted_quantiles(rows.join(F.broadcast(large), same, "left_anti"), names, wanted, keys)
    rows = rows.join(F.broadcast(large), same, "left_semi").withColumn("_b", ordered_bits(F.col("_v")))

    def inside(kept: DataFrame, bits: Column, columns: list[str]) -> tuple[DataFrame, Column]:
        """``kept`` with its keys renamed, and the condition that a row of the same keys has its prefix."""
        on = bits == F.col("_p")
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"{n}_"))
        return kept.select(*[F.col(n).alias(f"{n}_") for n in names], "_p", *columns), on

    def holding(each: DataFrame) -> DataFrame:
        """The counters that hold their rank."""
        held = each.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c")) | (F.col("_n") == 0))
        return held.select(*names, F.col("_q").alias("_p"), "_n", "_c", "name", "_r", "_before", "_low", "_high")

    def counted(found: DataFrame, shift: int) -> DataFrame:
        return found.groupBy(*names, F.shiftright("_b", shift).alias("_q")).agg(F.count("_v").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))

    def stored(found: DataFrame, name: str) -> DataFrame:
        found.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    shift = 64 - BITS
    first = counted(rows, shift).withColumn("_n", F.sum("_c").over(Window.partitionBy(*names)))
    first = first.withColumn("_before", F.sum("_c").over(Window.partitionBy(*names).orderBy("_q")) - F.col("_c"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), at.alias("_r")) for name, q in wanted.items() for at in (F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1)))])
    whole = stored(holding(first.select("*", F.inline(F.array_distinct(ranks)))), f"{shift}")
    while True:
        open_ = F.coalesce((F.col("_low") < F.col("_high")) & F.lit(shift > 0), F.lit(False))
        done, kept = whole.where(~open_), whole.where(open_)
        most = kept.agg(F.max("_c")).first()[0]
        if most is None:
            break
        marks, on = inside(kept, F.shiftright("_b", shift), [])
        found = rows.join(marks.distinct(), on, "left_semi")
        if most <= FEW:
            lists = found.groupBy(*names, F.shiftright("_b", shift).alias("_q")).agg(F.sort_array(F.collect_list("_v")).alias("_l"))
            marks, on = inside(kept, F.col("_q"), ["_n", "_c", "name", "_r", "_before"])
            at = F.get("_l", (F.col("_r") - F.col("_before")).cast("int"))
            sorted_ = lists.join(marks, on).select(*names, "_p", "_n", "_c", "name", "_r", "_before", at.alias("_low"), at.alias("_high"))
            done = stored(done.unionByName(sorted_), "last")
            break
        marks, on = inside(kept, F.shiftright("_q", BITS), ["_n", "name", "_r", F.col("_before").alias("_start")])
        inner = F.sum("_c").over(Window.partitionBy(*names, F.shiftright("_q", BITS)).orderBy("_q")) - F.col("_c")
        shift -= BITS
        each = counted(found, shift).withColumn("_inner", inner).join(marks, on).withColumn("_before", F.col("_start") + F.col("_inner"))
        whole = stored(holding(each).unionByName(done), f"{shift}")
    values = {}
    for name, q in wanted.items():
        at = q * (F.max("_n") - 1)
        low = F.min(F.when(F.col("name") == name, F.struct("_r", "_low")))["_low"]
        high = F.max(F.when(F.col("name") == name, F.struct("_r", "_low")))["_low"]
        values[name] = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    out = done.groupBy(*names).agg(*[v.alias(name) for name, v in values.items()])
    return small.unionByName(out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *wanted))


def _sorted_quantiles(rows: DataFrame, names: list[str], wanted: dict[str, float], keys: list[str]) -> DataFrame:
    """The quantiles of groups that are small enough to sort."""
    lists = rows.groupBy(*names).agg(F.sort_array(F.collect_list("_v")).alias("_l"))
    values = {}
    for name, q in wanted.items():
        at = q * (F.size("_l") - 1)
        low, high = F.get("_l", F.floor(at).cast("int")), F.get("_l", F.ceil(at).cast("int"))
        values[name] = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    return lists.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[v.alias(name) for name, v in values.items()])

"""Audit of how five filters interact in every order (operator 12).

Copies are found by an existential self-join: a document fails E if a row of the same hash, the same
exact text and a smaller doc_id exists. The ids that fail E are united with those that fail the
other filters, their bits are combined by id, and only counts by combination go on: every
order of the filters is read off at most 32 counts a part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables
from .quality import words_of

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: A hash of more than one in so many rows is hot; there are fewer such hashes than this.
HOT = 1000


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself (a null text must have been made empty)."""
    words = words_of(text)
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def with_repeated_texts(t: Tables, docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` without their texts as a written table with ``_row`` and, where the hash occurs under several ids, ``_text``, ``_h`` and ``_salts``.

    A first pass sees hashes only. Hashes of more than one in ``HOT`` rows, of which there are fewer than ``HOT``, are
    dealt over as many salts as keep a group below that share.
    """
    hashes = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), F.col(key).alias("_id"))
    counts = hashes.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"), F.max("_id").alias("_high"))
    repeated = t.write(counts.where("_low < _high").select("_h", "_n"), "repeated")
    share = docs.count() // HOT + 1
    salts = (F.col("_n") / share).cast("int") + 1
    hot = repeated.where(salts > 1).select(F.col("_h").alias("_hot"), salts.alias("_deal"))
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_text": F.coalesce(text, F.lit("")), "_h": F.xxhash64(F.coalesce(text, F.lit("")))})
    rows = rows.join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_deal")), F.lit(0)).cast("int")).drop("_hot", "_deal")
    each = repeated.select("_h", salts.alias("_salts"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    rows = rows.join(each, ["_h", "_salt"], "left")
    return t.write(rows.withColumn("_text", F.when(F.col("_salts").isNotNull(), F.col("_text"))).drop(text), "rows")


def later_copies(rows: DataFrame, key: str) -> DataFrame:
    """(_row) of the rows for whose exact text a smaller id exists: a left-semi join with the first id of each text."""
    some = rows.where("_text is not null").select("_row", F.col(key).alias("_id"), "_h", "_salt", "_salts", "_text")
    # one row a text, combined before the shuffle, then repeated for the salts of its hash
    first = some.groupBy("_h", "_text").agg(F.min("_id").alias("_first"), F.max("_salts").alias("_salts"))
    first = first.select("_h", "_text", "_first", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    same = [some[c] == first[c] for c in ("_h", "_salt", "_text")]
    return some.join(first, same[0] & same[1] & same[2] & (first["_first"] < some["_id"]), "left_semi").select("_row")


def combinations(t: Tables, docs: DataFrame, labels: DataFrame | None = None, *, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows by the set of filters that they fail, and how many of them are labelled.

    ``labels`` has ``key``, quality and toxic; rows of one key count as one label, which is good or toxic if any says so.
    Each row of ``docs`` counts, repeated ones too: rows that share an id aren't copies of each other. A null text
    is empty, a null part the empty string; a row without an id has no label, is no copy and makes none.
    """
    own = docs.select(F.col(key).alias("_id"), F.coalesce(part, F.lit("")).alias("part"), F.col(text).alias("_given"))  # other columns may be named like those here
    whole = F.coalesce("_given", F.lit(""))
    bits = sum((F.when(fails, BIT[f]).otherwise(0) for f, fails in failures(whole).items()), F.lit(0))
    rows = with_repeated_texts(t, own.withColumn("_bits", bits), "_given", "_id")
    failing = rows.select("_row", "_id", "part", "_bits")
    copied = later_copies(rows, "_id").select("_row", F.lit(None).cast(dict(rows.dtypes)["_id"]).alias("_id"), F.lit(None).cast("string").alias("part"), F.lit(BIT["E"]).alias("_bits"))
    by_row = failing.unionByName(copied).groupBy("_row").agg(F.max("_id").alias("_id"), F.max("part").alias("part"), F.bit_or("_bits").alias("mask"))
    known = by_row.groupBy("_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        marked = known.withColumns({"_good": F.lit(False), "_toxic": F.lit(False)})
    else:
        said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
        marked = known.join(said, "_id", "left")
    of = lambda mark: F.sum(F.when(F.coalesce(mark, F.lit(False)), F.col("n")).otherwise(0))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("_good").alias("good"), of("_toxic").alias("toxic"))


def audit(combined: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts by combination.

    kept: rows that pass all filters up to this step; removed: those that go here; redundant: fail here but had gone
    before; unique_fails: fail this filter only; good_lost, toxic_lost: labelled rows that go here; shapley: what this
    filter removes in all orders together. An empty table has no parts and gives no rows.
    """
    steps = [
        {"filter_order": "".join(p), "step": k + 1, "bit": BIT[f], "before": sum(BIT[x] for x in p[:k])}
        for p in permutations(FILTERS) for k, f in enumerate(p)
    ]
    parts = combined.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 entries a part at most
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    each = parts.select("part", "c", F.inline(plan))

    def total(column: str, when) -> Column:
        return F.aggregate(F.filter("c", lambda x: when(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x[column])

    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    goes = lambda m: fails(m) & ~earlier(m)
    out = each.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", goes).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", goes).alias("good_lost"),
        total("toxic", goes).alias("toxic_lost"),
    )
    every = F.sum("removed").over(Window.partitionBy("part", "bit"))  # one row an order
    return out.withColumn("shapley", every).drop("bit")


def interactions(docs: DataFrame, labels: DataFrame | None = None, **columns: str) -> DataFrame:
    """The audit of ``docs``; its tables go once the counts by combination are written."""
    t = Tables(docs.sparkSession, "filter-audit")
    counts = t.write(combinations(t, docs, labels, **columns), "combinations")
    t.drop("repeated", "rows")
    return audit(counts)

"""Line dedup by a suffix array over line ids (operator 1), DataFrame functions only.

The corpus is read as sequences of line ids, one sequence a document. Lines that occur once can't
be in a repeated run: they end the suffixes before them. The other suffixes are sorted by
prefix doubling: the class of a suffix by its first 2h lines comes from its class by h lines and
that of the suffix h lines on. Classes are numbered in their order by a range sort across
tasks; a suffix that is alone in its class has its place and isn't sorted again, and the
rounds end when no class has two. The common prefix of neighbours in that order is read off
their classes by halving steps. Where it falls below a length, an interval of suffixes ends that
share so many lines: the one that comes first in the corpus stays, the others are later
copies, whose lines go. Adjacent ones join to the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, let, may_hold, partitions


def _blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _numbered(t: Tables, found: DataFrame, order: list[str], number: str, name: str) -> DataFrame:
    """Add increasing numbers in ``order``, from a range sort. Written at once, so that a lost task can't number anew."""
    ordered = found.repartitionByRange(partitions(t.spark), *order).sortWithinPartitions(*order)
    return t.write(ordered.withColumn(number, F.monotonically_increasing_id()), name)


def _common(one: Column, two: Column) -> Column:
    """Length of the common beginning of two arrays without nulls; 0 if one is null."""
    differ = F.array_position(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(one.isNull() | two.isNull(), 0).when(differ > 0, differ - 1).otherwise(F.size(one)).cast("int")


def _shared_lines(levels: Column) -> Column:
    """Lines that suffixes of so many common classes share at least: 1, 2, 4, ..."""
    return F.when(levels > 0, F.pow(F.lit(2.0), levels - 1)).otherwise(0).cast("int")


def suffix_order(t: Tables, active: DataFrame) -> DataFrame:
    """(place, row, line, words, classes) of each suffix of repeated lines.

    ``active``: place, row, line, words, rank (the line's number in the order of lines). classes:
    the numbers of the suffix's classes by 1, 2, 4, ... lines, as far as others share them, then
    its own. The arrays are in the order of the suffixes; equal sequences go by their place.
    """
    here = ["place", "row", "line"]
    first = active.select(*here, "words", (F.col("rank") * 64).alias("id"), F.array("rank").alias("classes"), F.lit(2).cast("long").alias("n"))
    schema = ", ".join([*[f"`{c}` {kind}" for c, kind in first.dtypes], "level int"])
    tied = t.write(first, "named/level=0")
    level = 0

    def whole(last: int) -> DataFrame:
        """Each suffix once: from the round that gave it its place, or from the last one."""
        return t.read("named", schema).where(f"n = 1 or level = {last}").drop("level", "n")

    while not tied.isEmpty():
        level += 1
        step = 1 << (level - 1)
        after = whole(level - 1).select("row", (F.col("line") - step).alias("line"), F.col("id").alias("id2"), F.col("classes").alias("classes2"))
        both = t.write(tied.drop("n").join(after, ["row", "line"], "left"), f"both-{level}")
        # where the sequence ends each suffix is a class by itself, before those that go on
        ended = both.where("id2 is null").select("id", F.lit(None).cast("long").alias("id2"), F.lit(1).cast("long").alias("n"), F.col("classes").alias("c"), F.col("classes2").alias("c2"), *here, "words")
        pairs = both.where("id2 is not null").groupBy("id", "id2").agg(F.count(F.lit(1)).alias("n"), F.first("classes").alias("c"), F.first("classes2").alias("c2"))
        names = _numbered(t, pairs.unionByName(ended, allowMissingColumns=True), ["c", "c2", *here], "rank", f"names-{level}")
        named = both.where("id2 is not null").join(names.where("id2 is not null").select("id", "id2", "n", "rank"), ["id", "id2"]).select(*here, "words", "classes", "n", "rank")
        named = named.unionByName(names.where("id2 is null").select(*here, "words", F.col("c").alias("classes"), "n", "rank"))
        named = named.select(*here, "words", (F.col("rank") * 64 + level).alias("id"), F.concat("classes", F.array("rank")).alias("classes"), "n")
        named = t.write(named, f"named/level={level}")
        t.drop(f"names-{level}", f"both-{level}")
        tied = named.where("n > 1")
    return whole(level).drop("id")


def with_common_prefix(t: Tables, suffixes: DataFrame) -> DataFrame:
    """The suffixes in order: at (increasing), part (the sorted range), lcp (lines shared with the one before)."""
    sorted_ = _numbered(t, suffixes, ["classes"], "at", "sorted").withColumn("part", F.shiftright("at", 33))
    here = F.struct("classes", "row", "line")
    over = Window.partitionBy("part").orderBy("at")
    # the last suffix of the range before: a row for each range
    ends = sorted_.groupBy("part").agg(F.max_by(here, "at").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    pairs = sorted_.withColumn("before", F.lag(here).over(over)).join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "end"))
    levels = _common(F.col("classes"), F.col("before.classes"))
    pairs = pairs.select("at", "part", "place", "row", "line", "words", F.col("before.row").alias("row0"), F.col("before.line").alias("line0"), levels.alias("levels"))
    pairs = t.write(pairs.withColumn("lcp", _shared_lines(F.col("levels"))), "pairs-0")
    t.drop("sorted")
    plain, at = [pairs.where("levels < 2")], 0
    todo = pairs.where("levels > 1")
    known = suffixes.select("row", "line", "classes")
    while not todo.isEmpty():  # what is left of a common prefix is shorter than its last step
        at += 1
        one = known.toDF("_row", "_line", "_c")
        two = known.toDF("_row0", "_line0", "_c0")
        far = todo.join(one, (F.col("row") == F.col("_row")) & (F.col("line") + F.col("lcp") == F.col("_line")), "left")
        far = far.join(two, (F.col("row0") == F.col("_row0")) & (F.col("line0") + F.col("lcp") == F.col("_line0")), "left")
        far = far.withColumn("levels", F.least(F.col("levels") - 1, _common(F.col("_c"), F.col("_c0"))))
        far = t.write(far.withColumn("lcp", F.col("lcp") + _shared_lines(F.col("levels"))).select(*pairs.columns), f"pairs-{at}")
        plain.append(far.where("levels < 2"))
        todo = far.where("levels > 1")
    whole = plain[0]
    for d in plain[1:]:
        whole = whole.unionByName(d)
    return whole.select("at", "part", "place", "row", "line", "words", "lcp")


def repeated_lines(t: Tables, lines: DataFrame) -> DataFrame:
    """(place, row, line, words, rank) of the lines that occur twice or more; rank numbers them in the order of their hashes."""
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    # a line that stands in a third of all documents is a hot key here: both sides are
    # plain exchanges, whose large partitions adaptive execution splits
    names = _numbered(t, repeated, ["h1", "h2"], "rank", "lines")
    return lines.join(names, ["h1", "h2"]).select("place", "row", "line", "words", "rank")


def copied_lines(t: Tables, lines: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """(row, line) of every line inside a run that also stands earlier in the corpus.

    ``lines``: place (sortable place of the document in the corpus), row (the document's
    key), line (0, 1, ...), h1 and h2 (the line's 128-bit hash), words. A run counts if
    it has ``min_lines`` lines or ``min_words`` words. Longer runs are covered by the intervals of
    ``min_lines`` at each of their places, shorter ones count by their words.
    """
    suffixes = suffix_order(t, repeated_lines(t, lines))
    ordered = with_common_prefix(t, suffixes)
    # intervals that share d lines: numbered by where the common prefix is shorter
    over = Window.partitionBy("part").orderBy("at")
    depths = range(1, min_lines + 1)
    follow = Window.partitionBy("row").orderBy("line")
    ordered = ordered.withColumns({f"w{d}": F.sum("words").over(follow.rowsBetween(0, d - 1)) for d in depths})
    starts = {d: F.sum((F.coalesce("lcp", F.lit(0)) < d).cast("long")).over(over) for d in depths}
    ordered = t.write(ordered.withColumns({f"i{d}": c for d, c in starts.items()} | {"next": F.lead("lcp").over(over)}), "intervals")
    sums = ordered.groupBy("part").agg(*[F.max(f"i{d}").alias(f"s{d}") for d in depths])  # a row for each range
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *[F.coalesce(F.sum(f"s{d}").over(ranges), F.lit(0)).alias(f"s{d}") for d in depths])
    counts = lambda d: F.lit(True) if d == min_lines else F.col(f"w{d}") >= min_words
    shared = lambda d: (F.col("lcp") >= d) | F.coalesce(F.col("next") >= d, F.lit(True))
    member = [F.when(counts(d) & shared(d), F.struct(F.lit(d).alias("len"), (F.col(f"i{d}") + F.col(f"s{d}")).alias("interval"))) for d in depths]
    members = ordered.join(F.broadcast(sums), "part").select("place", "row", "line", F.explode(F.array_compact(F.array(*member))).alias("x"))
    members = t.write(members.select("place", "row", "line", "x.*"), "members")
    first = members.groupBy("len", "interval").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "row", "line")).alias("first")).where("n > 1")
    copies = members.join(first, ["len", "interval"]).where(F.struct("place", "row", "line") != F.col("first"))
    return copies.select("row", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("len") - 1)).alias("line")).distinct()


def dedup_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    order: str = "doc_id",
    carry: list[str] | None = None,
    min_lines: int = 3,
    min_words: int = 50,
    slots: int = 1 << 22,
) -> DataFrame:
    """Documents without the lines that repeat an earlier run of lines.

    Lines end at ``\\n``; the words of a line are its blanks plus one. Blank lines are lines like others, so
    a run of blank ones that stands earlier goes too. The corpus is in the order of ``order`` (nulls
    last), equal ones in the order in which they are read; the first copy of a run stays,
    also when the later one is in the same document. Returns the columns ``carry``
    (default: all) with ``text`` cut down, and n_lines, n_removed and n_spans (maximal removed runs), which
    replace columns of these names. A null text stays null with 0 lines, an empty text is
    one empty line, an empty table gives an empty result. A copy that loses all its
    lines is left with an empty text. ``slots`` is the size in bits of a map of the rows that lose lines.
    """
    made = ("n_lines", "n_removed", "n_spans")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*made, text)]
    numbered = docs.select(
        F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("id")).alias("place"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("_text"),
        *([F.struct(*carry).alias("_rest")] if carry else []),
    )
    t = Tables(docs.sparkSession, "line-dedup")
    numbered = t.write(numbered, "docs")
    split = F.split("_text", "\n")
    # (line, words so far) for each line of the text
    lines = numbered.where(F.col("_text").isNotNull()).select("place", "row", F.posexplode(split).alias("line", "_line"))
    lines = lines.select(
        "place", "row", "line", F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit(1), "_line").alias("h2"), (_blanks(F.col("_line")) + 1).alias("words")
    )
    gone = copied_lines(t, lines, min_lines, min_words).groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("_gone"))
    gone = t.write(gone.withColumnRenamed("row", "_row"), "gone")
    # texts that lose nothing aren't shuffled, but for those that share their bit with one that does
    marked = numbered.withColumn("_hit", may_hold(gone, "_row", slots)(F.col("row")))
    some = marked.where("_hit").join(gone, F.col("row") == F.col("_row"), "left")
    joined = some.unionByName(marked.where("not _hit").withColumns({"_row": F.lit(None).cast("long"), "_gone": F.lit(None).cast("array<int>")}))
    parts = F.split("_text", "\n")
    n_lines = F.size(parts)
    stays = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_gone"))
    rest = let(parts, lambda p: F.array_join(F.transform(stays, lambda i: F.get(p, i)), "\n"))
    gaps = F.filter(F.col("_gone"), lambda x, j: (j == 0) | (F.get(F.col("_gone"), j - 1) != x - 1))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        *[F.col("_rest")[c].alias(c) for c in carry],
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest).alias(text),
        count(F.when(F.col("_text").isNotNull(), n_lines)).alias("n_lines"),
        count(F.when(F.col("_gone").isNotNull(), F.size("_gone"))).alias("n_removed"),
        count(F.when(F.col("_gone").isNotNull(), F.size(gaps))).alias("n_spans"),
    )

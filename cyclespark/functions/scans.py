"""Windows and folds along groups that may be longer than a task can hold.

Rows are sorted once into ranges, which are written; a long group spans many ranges, a range holds many short
groups. What a range hands on to the next ones is a row for each group in it: the value of its last row, a
sum, the last known value, the state of a fold. Those few rows are carried along by windows over the ranges, and
each range is finished by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.functions.folds import sorted_fold
from cyclespark.sources.shared import discard, scratch

#: Where ranges name their table, in the metadata of _at.
TABLE = "cyclespark.table"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read.withMetadata("_at", {TABLE: path}) if "_at" in df.columns else read


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in sorted ranges: adds _at, which increases in ``order`` (its first columns are the group), and _range.

    Equal rows get an order of their own, which is written and so stays the same. Null keys are sorted as others but
    belong to no group: callers drop them.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return _stored(ranges, "ranges").withColumn("_range", F.shiftright("_at", 33))


def across(
    rows: DataFrame, group: list[str], *, previous: dict[str, str] | None = None, following: dict[str, str] | None = None,
    totals: dict[str, str] | None = None, known: dict[str, str] | None = None, prior: dict[str, str] | None = None, upcoming: dict[str, str] | None = None, constants: DataFrame | None = None, spent: bool = False,
) -> DataFrame:
    """``rows`` of ``in_ranges`` with further columns, each named new: old, as if by windows over whole groups.

    previous, following: structs with the value of the row before and after, null at the group's ends; totals: sum
    up to the row; known, prior, upcoming: the last non-null value up to the row, before it, the next one from it on; constants: a
    table with one row a group, whose other columns are added. The result is written, so that calls can follow each other;
    ``spent`` says that ``rows`` isn't used after this one, so that their table goes.
    """
    previous, following, totals, known, prior, upcoming = (x or {} for x in (previous, following, totals, known, prior, upcoming))
    keys = [*group, "_range"]
    up, down = Window.partitionBy(*keys).orderBy("_at"), Window.partitionBy(*keys).orderBy(F.desc("_at"))
    ranges, back = Window.partitionBy(*group).orderBy("_range"), Window.partitionBy(*group).orderBy(F.desc("_range"))
    earlier, later = ranges.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    there = lambda old: F.when(F.col(old).isNotNull(), F.col("_at"))
    ends = (
        [F.max_by(F.struct(F.col(old).alias("v")), "_at").alias(f"_c_{new}") for new, old in previous.items()]
        + [F.min_by(F.struct(F.col(old).alias("v")), "_at").alias(f"_c_{new}") for new, old in following.items()]
        + [F.sum(old).alias(f"_c_{new}") for new, old in totals.items()]
        + [F.max_by(old, there(old)).alias(f"_c_{new}") for new, old in (known | prior).items()]
        + [F.min_by(old, there(old)).alias(f"_c_{new}") for new, old in upcoming.items()]
    )
    summary = rows.groupBy(*keys).agg(*(ends or [F.count(F.lit(1)).alias("_c_")]))
    carried = (
        {f"_c_{new}": F.lag(f"_c_{new}").over(ranges) for new in previous}
        | {f"_c_{new}": F.lead(f"_c_{new}").over(ranges) for new in following}
        | {f"_c_{new}": F.sum(f"_c_{new}").over(earlier) for new in totals}
        | {f"_c_{new}": F.last(f"_c_{new}", ignorenulls=True).over(earlier) for new in known | prior}
        | {f"_c_{new}": F.last(f"_c_{new}", ignorenulls=True).over(later) for new in upcoming}
    )
    summary = summary.withColumns(carried)
    if constants is not None:
        summary = summary.join(constants, group, "left")
    running = up.rowsBetween(Window.unboundedPreceding, 0)
    own = lambda old: F.struct(F.col(old).alias("v"))
    new_columns = (
        {new: F.coalesce(F.lag(own(old)).over(up), f"_c_{new}") for new, old in previous.items()}
        | {new: F.coalesce(F.lead(own(old)).over(up), f"_c_{new}") for new, old in following.items()}
        | {new: F.coalesce(F.sum(old).over(running) + F.coalesce(f"_c_{new}", F.lit(0)), f"_c_{new}") for new, old in totals.items()}
        | {new: F.coalesce(F.last(old, ignorenulls=True).over(running), f"_c_{new}") for new, old in known.items()}
        | {new: F.coalesce(F.last(old, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)), f"_c_{new}") for new, old in prior.items()}
        | {new: F.coalesce(F.last(old, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)), f"_c_{new}") for new, old in upcoming.items()}
    )
    out = rows.join(summary, keys).withColumns(new_columns)
    written = _stored(out.drop(*[c for c in summary.columns if c.startswith("_c_")]), "across")
    if spent and (table := rows.schema["_at"].metadata.get(TABLE)):
        discard(rows.sparkSession, table)
    return written


def ranged_fold(
    df: DataFrame, group: list[str], order: list[str], inputs: list[str], name: str, kind: str, state: str,
    step: Callable, facts: dict, leap: Callable, columns: dict | None = None,
) -> DataFrame:
    """Add ``name``: the output of ``step(state, *inputs) -> (state, output)`` along each group, the first state None.

    Ranges are folded side by side: each first from None, then from the state in which the ranges before it end. That
    state comes from ``leap(state, end, facts)``: the state after a range that is entered in ``state``, where ``end`` is its end
    from None and ``facts`` are aggregates of its rows (by name), also of ``columns`` added to them. The leap may be off by rounding: a range that
    ends otherwise than foretold corrects those after it in another round. ``state`` is the SQL type of states.
    """
    keys, names = [*group, "_range"], list(facts)
    rows = in_ranges(df, [*group, *order])

    def ends(entered: DataFrame | None) -> DataFrame:
        """The state in which each range ends, a row for each group in it."""
        begun = ["_in"] if entered is not None else []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, now, out = None, None, []
            for b in batches:
                columns = [b[c] for c in (*keys, *inputs, *begun)]
                for row in zip(*columns, strict=True):
                    key, row = row[: len(keys)], row[len(keys) :]
                    if key != last:
                        if last is not None:
                            out.append((*last, now))
                        last, now = key, (None if not begun or pd.isna(row[-1]) else row[-1])
                    now = step(now, *row[: len(inputs)])[0]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=[*keys, "_end"])
                    out = []
            if last is not None:
                out.append((*last, now))
            yield pd.DataFrame(out, columns=[*keys, "_end"])

        source = rows if entered is None else rows.join(entered.select(*keys, "_in"), keys)
        wanted = source.select(*keys, *inputs, "_at", *begun)
        types = dict(wanted.dtypes)
        sorted_ = wanted.repartition(*keys).sortWithinPartitions(*keys, "_at")
        return sorted_.mapInPandas(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"_end {state}"]))

    def carry(now, end, *given):
        now, end = (None if x is None or pd.isna(x) else x for x in (now, end))
        return leap(now, end, dict(zip(names, given, strict=True)))

    def entered_from(known: DataFrame) -> DataFrame:
        """_in for each range of a group: a fold over the ranges' rows, of which there are as many as the group has ranges."""

        def over(now, *given):
            return carry(now, *given), now

        return _stored(sorted_fold(known, group, ["_range"], ["_end", *names], "_in", state, lambda: None, over), "entered")

    summary = rows.withColumns(columns or {}).groupBy(*keys).agg(*[f.alias(n) for n, f in facts.items()])
    known = _stored(ends(None).join(summary, keys), "range-ends")
    entered = entered_from(known)
    while True:
        true_ends = _stored(ends(entered).withColumnRenamed("_end", "_true"), "true-ends")
        w = Window.partitionBy(*group).orderBy("_range")
        told = entered.join(true_ends, keys).withColumns({"_next": F.lead("_in").over(w), "_more": F.lead("_range").over(w)})
        wrong = told.where(F.col("_more").isNotNull() & ~F.col("_next").eqNullSafe(F.col("_true")))
        if wrong.isEmpty():
            break
        # ranges before a group's first error are right; the one after it is entered as that one ends
        first = wrong.groupBy(*group).agg(F.min("_more").alias("_fix"), F.min_by("_true", "_more").alias("_fixed"))
        entered = _stored(_corrected(entered, first, group, state, names, carry), "entered")
    out = sorted_fold_from(rows.join(entered.select(*keys, "_in"), keys), keys, inputs, name, kind, step)
    return out.drop("_at", "_range", "_in")


def _corrected(entered: DataFrame, first: DataFrame, group: list[str], state: str, names: list[str], carry: Callable) -> DataFrame:
    """``entered`` with the states from each group's first error on told anew."""

    def over(now, range_, in_, end, fix, fixed, *given):
        """now: the state foretold for this range once the error has been passed, in a tuple."""
        start = fixed if range_ == fix else now[0] if now else in_
        return ((carry(start, end, *given),) if now or range_ == fix else None), start

    marked = entered.withColumnRenamed("_in", "_old").join(first, group, "left")
    told = sorted_fold(marked, group, ["_range"], ["_range", "_old", "_end", "_fix", "_fixed", *names], "_in", state, lambda: None, over)
    return told.drop("_old", "_fix", "_fixed")


def sorted_fold_from(rows: DataFrame, keys: list[str], inputs: list[str], name: str, kind: str, step: Callable) -> DataFrame:
    """As ``sorted_fold`` along ranges, each from its own _in."""

    def run(now, first, *row):
        began = (None if pd.isna(first) else first) if now is None else now[0]
        after, out = step(began, *row)
        return (after,), out

    return sorted_fold(rows, keys, ["_at"], ["_in", *inputs], name, kind, lambda: None, run)

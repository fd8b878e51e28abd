"""Quality rules with host-level verdicts (operator 7), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, salted_left_join

#: Words are runs of anything but the six ASCII white-space characters.
SEPARATORS = r"[ \t-\r]+"
WINDOW = 8
#: Soft rules: a document may break them, unless its host breaks them as a habit.
RULES = ("symbols", "lines", "lengths")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that stand twice or more in ``words``.

    Windows are compared by a 64-bit hash. Only a text that has two equal hashes is
    sorted, so most texts cost one pass.
    """
    n = F.size(words) - (width - 1)
    hashes = F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, width)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        steps = F.transform(
            starts,
            lambda p, j: F.when(j < last, F.least(F.lit(width), F.get(starts, j + 1) - p)).otherwise(F.lit(width)),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda e, j: (e["h"] == F.get(s, j - 1)["h"]).eqNullSafe(F.lit(True))
                        | (e["h"] == F.get(s, j + 1)["h"]).eqNullSafe(F.lit(True)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(starts, covered)).otherwise(F.lit(0))

    return let(hashes, count).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts on which the rules rest, each over the whole text (null: empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    per_text = let(
        words_of(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    per_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return (
        docs.withColumn("_w", per_text)
        .withColumn("_l", per_line)
        .withColumn("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumns({c: F.col("_w")[c] for c in ("n_words", "word_chars", "n_repeat_words")})
        .withColumns({c: F.col("_l")[c] for c in ("n_lines", "n_dup_lines")})
        .drop("_w", "_l")
    )


def verdicts(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    carry: list[str] | None = None,
    host_rate: float = 0.5,
    symbol_ratio: float = 0.1,
    dup_line_share: float = 0.3,
    word_length: tuple[float, float] = (2.0, 12.0),
    salts: int = 64,
) -> DataFrame:
    """Documents with their counts, ``base_failed`` and ``kept``.

    Base rule: under 20 words, or over 30 % of the words in repeated 8-word windows.
    Soft rules: symbols a word, share of repeated lines, mean word length. Failures are
    summed by host; each rate is shrunk with a beta prior fitted to all hosts by
    moments; a host whose shrunk rate reaches ``host_rate`` is condemned for that rule.
    A document goes if its base rule failed, or if it breaks a soft rule for which its
    host is condemned. So a clean document stays, whatever its host.

    Null text counts as empty, a null host is a host of its own, rows are judged one
    by one (repeated ids are fine), an empty table gives an empty result. Columns of
    ``docs`` named in ``carry`` (default: all) come along; counts replace columns of the same name.
    """
    carry = [c for c in (docs.columns if carry is None else carry)]
    made = ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols")
    inner = docs.select(
        F.col(text).alias("_text"), F.col(host).alias("_host"), F.struct(*carry).alias("_row")
    )
    counted = features(inner, "_text").drop("_text")
    mean_length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    counted = counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "_symbols": F.col("n_symbols") > symbol_ratio * F.col("n_words"),
            "_lines": F.col("n_dup_lines") > dup_line_share * F.col("n_lines"),
            "_lengths": (mean_length < word_length[0]) | (mean_length > word_length[1]),
        }
    )
    counted = cut(counted, "quality")

    hosts = counted.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"_{r}")).alias(f"f_{r}") for r in RULES]
    )
    prior = hosts.agg(
        *[(F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES],
        F.avg(1 / F.col("n")).alias("inverse_n"),
    )
    # one row: the prior's moments
    joined = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior.withColumn("_one", F.lit(1))), "_one")
    bad = {}
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        noise = m * (1 - m) * F.col("inverse_n")
        spread = F.greatest(v - noise, F.lit(1e-9))
        weight = F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)), F.lit(1e6))
        bad[f"bad_{r}"] = (F.col(f"f_{r}") + m * weight) / (F.col("n") + weight) >= host_rate
    condemned = joined.select("_host", *[F.coalesce(e, F.lit(False)).alias(k) for k, e in bad.items()]).where(
        " or ".join(bad)
    )

    soft = F.col("_symbols") | F.col("_lines") | F.col("_lengths")
    asked = ~F.col("base_failed") & soft
    plain = counted.where(~asked).withColumn("kept", ~F.col("base_failed"))
    judged = salted_left_join(
        counted.where(asked), condemned, ["_host"], ["n_words", "word_chars", "n_symbols"], salts
    )
    hit = F.lit(False)
    for r in RULES:
        hit = hit | (F.col(f"_{r}") & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    judged = judged.withColumn("kept", ~hit).drop(*bad)
    rest = [c for c in carry if c not in made and c not in ("base_failed", "kept")]
    return plain.unionByName(judged).select(*[F.col("_row")[c].alias(c) for c in rest], *made, "base_failed", "kept")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with the columns of ``docs``."""
    packed = docs.select("text", "source", F.struct(*docs.columns).alias("_doc"))
    kept = verdicts(packed, carry=["_doc"], **options).where("kept")
    return kept.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

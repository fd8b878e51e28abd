"""Personal data by bootstrapped contextual extraction (operator 10), DataFrame functions only.

Seeds are the spans that four fixed forms find (e-mail, IP, card, phone). The words
around seeds become lexical patterns; patterns and the values they enclose form a
bipartite graph, whose two sides are scored in turns: a pattern by the share of its
values that are believed to be of a kind, a value by the patterns around it. Values that
look like identifiers, that no form found, and that stand in patterns of high confidence
are added, and support further patterns in the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, blocks_of, count_below, cut, let, part_of, running

KINDS = ("email", "ip", "card", "phone")

#: The contract's forms, written without backtracking over runs: a run can only begin
#: where the character before is not of the run, or right after the last match.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What looks like an identifier: a word with a digit or an at sign.
TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"

#: A word of a pattern, and what may stand between a span and the next one.
ONE = r"[^ \t-\r]+"
CLOSING = r"[.,;:!?)\"']*[ \t-\r]*"
#: Words make a pattern if they begin and end within so many code points of the span.
REACH = 1000

SPAN = "struct<s:int,e:int,t:string>"


def _spans(text: Column, form: str) -> Column:
    """All matches as (start, end, text); places are code points, the end is exclusive."""

    def place(between: Column, hits: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda x, h: F.length(x) + F.length(h))
        ends = running(steps, lambda x, y: x + y)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("s"), e.alias("e"), h.alias("t")))

    hits = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(text, form, -1), lambda b: place(b, h))).otherwise(none))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, each second one doubled, is divisible by ten."""

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the four forms: struct of one array of (s, e, t) a kind."""
    none = F.array().cast(f"array<{SPAN}>")
    size = lambda x: F.length(_digits(x["t"]))
    small = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    asked = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
        "phone": text.rlike(r"\+[0-9]"),
    }
    holds = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["t"].rlike(small),
        "card": lambda x: size(x).between(16, 19) & _luhn(_digits(x["t"])),
        "phone": lambda x: size(x).between(8, 15),
    }
    return F.struct(*[F.when(asked[k], F.filter(_spans(text, FORMS[k]), holds[k])).otherwise(none).alias(k) for k in KINDS])


def _label(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("v")))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def _marked(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """Each row with its key, its seeds (k, s, e, v) and further words that look like identifiers."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    inner = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), F.struct(*carry).alias("_rest"))
    rows = inner.withColumn("_base", base_spans(whole))
    seeds = F.flatten(
        F.array(*[_of_kind(F.col("_base")[k], k) for k in KINDS])
    )
    rows = rows.withColumn("seeds", seeds)
    begins, ends = (F.array_sort(F.col(f"seeds.{c}")) for c in ("s", "e"))
    tokens = F.coalesce(F.when(whole.rlike("[0-9@]"), _spans(whole, TOKEN)), F.array().cast(f"array<{SPAN}>"))
    # what is bound here is worked out once a text; inside a lambda it would be once a span
    given = F.struct(begins.alias("begins"), ends.alias("ends"), blocks_of(whole).alias("blocks"), F.length(whole).alias("size"))

    def frames(c: Column) -> Column:
        # a word is free if as many seeds have ended before it as have begun before its end
        free = F.filter(
            tokens,
            lambda x: ((F.length(_digits(x["t"])) >= 4) | F.contains(x["t"], F.lit("@")))
            & (count_below(c["begins"], x["e"]) == count_below(c["ends"], x["s"] + 1)),
        )
        none = F.lit(None).cast("string")
        every = F.concat(F.col("seeds"), F.transform(free, lambda x: F.struct(none.alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("v"))))
        return F.transform(every, lambda x: framed(c, x))

    def before(c: Column, x: Column, words: str) -> Column:
        """The last words before a span; a short look back where it holds them whole, else a long one."""

        def look(n: int) -> Column:
            part = part_of(c["blocks"], F.greatest(x["s"] - n, F.lit(0)), F.least(x["s"], F.lit(n)))
            return let(part, lambda p: F.when((x["s"] <= n) | p.rlike(rf"[ \t-\r]{words}[ \t-\r]*$"), F.regexp_extract(p, rf"(?:^|[ \t-\r])({words})[ \t-\r]*$", 1)))

        return F.lower(F.coalesce(look(40), look(REACH), F.lit("")))

    def after(c: Column, x: Column) -> Column:
        def look(n: int) -> Column:
            part = part_of(c["blocks"], x["e"], F.least(c["size"] - x["e"], F.lit(n)))
            return let(part, lambda p: F.when((c["size"] - x["e"] <= n) | p.rlike(rf"^{CLOSING}{ONE}[ \t-\r]"), F.regexp_extract(p, rf"^{CLOSING}({ONE})", 1)))

        return F.lower(F.coalesce(look(30), look(REACH), F.lit("")))

    def framed(c: Column, x: Column) -> Column:
        return F.struct(
            x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"),
            before(c, x, ONE).alias("l1"), before(c, x, rf"{ONE}[ \t-\r]+{ONE}").alias("l2"), after(c, x).alias("r1"),
        )

    return rows.withColumn("found", let(given, frames)).drop("_base")


def discovered(marked: DataFrame, *, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """(_row, k, s, e) of words that patterns of high confidence enclose.

    Patterns are the two words before, and the word before with the word after. Copies of
    a document count once: the graph joins distinct patterns and values. In each of ``rounds``
    rounds a pattern of ``support`` distinct values that are believed to be of a kind gets its share of
    them as confidence for that kind; a value is believed that is a seed of the kind or
    that patterns of ``confidence`` enclose (noisy or). So values found in one round support new
    patterns in the next, which need no seed of their own.
    """
    t = Tables(marked.sparkSession, "pii")
    spot = marked.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    left2 = F.when(F.col("l2") != "", F.concat(F.lit("L\t"), "l2"))
    both = F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("B\t"), "l1", F.lit("\t"), "r1"))
    spot = spot.withColumn("p", F.explode(F.array_compact(F.array(left2, both))))
    edges = spot.groupBy("p", "v").agg(*[F.max(F.coalesce(F.col("k") == k, F.lit(False))).alias(k) for k in KINDS])
    # a pattern of fewer values never gets support: its edges go
    enough = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    edges = t.write(edges.join(enough, "p"), "edges")
    seed = {k: F.when(F.col(k), 1.0).otherwise(0.0) for k in KINDS}
    belief = edges.select("p", "v", "n", *[seed[k].alias(f"b_{k}") for k in KINDS])
    for at in range(rounds):
        held = {k: F.sum((F.col(f"b_{k}") >= confidence).cast("long")) for k in KINDS}
        scores = belief.groupBy("p").agg(*[F.when(held[k] >= support, F.sum(f"b_{k}") / F.first("n")).otherwise(0.0).alias(f"c_{k}") for k in KINDS])
        best = F.greatest(*[F.col(f"c_{k}") for k in KINDS])
        good = t.write(scores.where(best >= confidence), f"patterns-{at}")
        if at + 1 < rounds:
            # noisy or over the good patterns around a value
            doubt = [F.exp(F.sum(F.log(F.greatest(1 - F.when(F.col(f"c_{k}") >= confidence, F.col(f"c_{k}")).otherwise(0.0), F.lit(1e-9))))).alias(f"d_{k}") for k in KINDS]
            values = edges.join(good, "p").groupBy("v").agg(*doubt)
            found = lambda k: F.greatest(seed[k], 1 - F.coalesce(F.col(f"d_{k}"), F.lit(1.0)))
            belief = t.write(edges.join(values, "v", "left").select("p", "v", "n", *[found(k).alias(f"b_{k}") for k in KINDS]), f"values-{at}")
    kind = F.coalesce(*[F.when(F.col(f"c_{k}") == best, F.lit(k)) for k in KINDS])
    hits = spot.where(F.col("k").isNull()).join(good.select("p", kind.alias("kind"), best.alias("c")), "p")
    return hits.groupBy("_row", "s", "e").agg(F.max(F.struct("c", "kind"))["kind"].alias("k"))


def find(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, **bootstrap) -> DataFrame:
    """The rows of ``docs`` with their spans.

    Adds seeds (the spans of the four forms by kind as listed, then start) and extra
    (discovered spans by start), both arrays of (k, s, e): kind, start and exclusive end
    in code points; they replace columns of these names. A null text counts as empty and has none. Rows are
    keyed as they are read, so repeated ids and rows are each judged; an empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("seeds", "extra")]
    marked = cut(_marked(docs, text, carry).drop(*([] if text in carry else ["_text"])), "pii-spans")
    extra = discovered(marked, **bootstrap)
    extra = extra.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "k"))).alias("extra")).withColumnRenamed("_row", "_of")
    # only rows with unclaimed words can gain spans; the others aren't shuffled
    open_ = F.exists("found", lambda x: x["k"].isNull())
    slim = lambda a: F.transform(a, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    out = [F.col("_rest")[c].alias(c) for c in carry]
    none = F.array().cast("array<struct<k:string,s:int,e:int>>")
    some = marked.where(open_).drop("found").join(extra, F.col("_row") == F.col("_of"), "left")
    some = some.select(*out, slim(F.col("seeds")).alias("seeds"), F.coalesce(slim(F.col("extra")), none).alias("extra"))
    rest = marked.where(~open_).select(*out, slim(F.col("seeds")).alias("seeds"), none.alias("extra"))
    return some.unionByName(rest)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the seeds and all spans as text."""
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(
        F.transform(F.concat("seeds", "extra"), lambda x: F.struct(F.array_position(order, x["k"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    )
    return found.select(
        key,
        *[_count(F.col("seeds"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_label(F.col("seeds")), 256).alias("base_sha256"),
        _label(ranked).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", **bootstrap) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first goes, its end extended."""
    whole = docs.select(text, F.struct(*docs.columns).alias("_doc"))  # user columns may be named like those of find
    found = find(whole, text=text, **bootstrap)
    order = F.array_sort(F.transform(F.concat("seeds", "extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    given = F.col(text)

    def without(spans: Column, reach: Column, blocks: Column) -> Column:
        """The gaps between spans that don't begin inside earlier ones, each with the mark of the span after it, and the rest."""
        since = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        mark = lambda x: F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))
        parts = F.transform(spans, lambda x, i: F.when(x["s"] >= since(i), F.concat(part_of(blocks, since(i), x["s"] - since(i)), mark(x))).otherwise(F.lit("")))
        rest = part_of(blocks, since(F.size(spans)), F.length(given) - since(F.size(spans)))
        return F.concat(F.array_join(parts, ""), rest)

    # how far the spans up to each one reach
    far = lambda spans: running(F.transform(spans, lambda x: x["e"]), lambda x, y: F.greatest(x, y))
    new = let(order, lambda spans: let(far(spans), lambda reach: let(blocks_of(given), lambda blocks: without(spans, reach, blocks))))
    changed = F.size("seeds") + F.size("extra") > 0
    return found.select(*[(F.when(changed, new).otherwise(given) if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])

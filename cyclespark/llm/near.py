"""MinHash near-duplicates by a multi-index Hamming join (operator 6).

A document's set of word shingles gets a signature of ``symbols`` b-bit MinHash values.
Pairs within ``errors`` differing symbols are found by pigeonhole: the signature is cut
into ``chunks`` parts, so that some part of any such pair differs in at most
``errors // chunks`` symbols, and each part is indexed once for every choice of as many
symbols to leave out. So the join misses no pair under the signature distance; the
distance is set so that a pair at the similarity asked for exceeds it with a probability
under 2e-5. Candidates are confirmed on the full sets.

Equal sets are one class. In each bucket of the index the members of about one size are
first compared with the smallest and the largest of them, which joins a group of copies with
two pairs a member. Members of buckets that still hold different components are
compared further by exact prefixes: sorted by how frequent its shingles are, two sets over the
similarity share one of the rarest few, fewer the nearer their sizes are. So copies that differ from a
common text each by their own words meet at those words only, and no link between components is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

_words: dict[bytes, int] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are runs of anything but ASCII white space, A-Z in lower case. With fewer than
    ``width`` words the whole sequence is one shingle; without words there is none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 300_000:
        _words.clear()
    known = _words
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = (total + h[j : j + n]) * _MIX[j % len(_MIX)]
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


_rng = np.random.default_rng(11)
_odd = _rng.integers(0, 2**31, 256, np.uint32) * np.uint32(2) + np.uint32(1)
_products = np.empty((256, 1024), np.uint32)


def signature(sets: np.ndarray, symbols: int) -> np.ndarray:
    """``symbols`` (up to 256) 16-bit MinHash values of a set of hashes.

    The hashes are mixed already, so 32 of their bits under odd multipliers serve as permutations.
    """
    odd = _odd[:symbols, None]
    h = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(symbols, np.uint32(2**32 - 1))
    for at in range(0, len(h), 1024):  # bounds the table of a long text
        part = h[None, at : at + 1024]
        least = np.minimum(least, np.multiply(part, odd, out=_products[:symbols, : part.shape[1]]).min(1))
    return (_mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def index_plan(symbols: int, errors: int, chunks: int) -> list[tuple[int, ...]]:
    """The symbols of each key: every part, less each choice of errors // chunks symbols."""
    parts = np.array_split(np.arange(symbols), chunks)
    out = errors // chunks
    return [tuple(int(i) for i in kept) for p in parts for kept in itertools.combinations(p, max(1, len(p) - out))]


def sketch(docs: DataFrame, key: str, text: str, width: int, symbols: int) -> DataFrame:
    """(key, n, s1, s2, sig): set size, 128-bit digest of the set, signature (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                s = shingles(t, width)
                digest = xxhash.xxh128_digest(s.tobytes())
                rows.append((k, len(s), *np.frombuffer(digest, np.int64).tolist(), signature(s, symbols).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=[key, "n", "s1", "s2", "sig"]).astype({key: b[key].dtype})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, n long, s1 long, s2 long, sig binary")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int, most_slots: int = 1 << 24) -> DataFrame:
    """(columns of ids, r, n, shingles as array<long>) for each text of ``ids``, which has distinct keys.

    r tells the texts of one key apart, n is the size of the set. A bitmap keeps most other
    texts from being shingled; it has about 16 bits an id, up to ``most_slots``. The exact join
    follows on the sets.
    """
    slots = min(most_slots, max(1 << 16, 1 << int(16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    bit = F.expr("shiftleft(1L, _slot % 64)")
    words = ids.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    asked = np.zeros(slots // 64, np.int64)
    asked[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)  # slots / 64 rows at most
    wanted = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = wanted.value.view(np.uint64)
        for b in batches:
            at = b["slot"].to_numpy()
            b = b[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0]
            if len(b):
                sets = [shingles(t, width).view(np.int64) for t in b[text]]
                r = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pd.DataFrame({key: b[key], "r": r, "n": [len(s) for s in sets], "shingles": sets})

    rows = docs.select(key, text, slot.alias("slot"))
    sets = rows.mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, r long, n long, shingles array<long>")
    return ids.join(sets, key)


def keys_of(sketches: DataFrame, plan: list[tuple[int, ...]]) -> DataFrame:
    """(bucket, id, n): a row for each key of the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mixed(np.arange(1, len(plan) + 1, dtype=np.uint64))
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), -1).astype(np.uint64)
            keys = np.empty((len(b), len(plan)), np.uint64)
            for j, kept in enumerate(plan):
                h = np.full(len(b), salt[j])
                for i in kept:
                    h = (h ^ sig[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
                keys[:, j] = _mixed(h)
            each = {c: np.repeat(b[c].to_numpy(), len(plan)) for c in ("id", "n")}
            yield pd.DataFrame({"bucket": keys.view(np.int64).ravel(), **each})

    return sketches.select("id", "n", "sig").mapInPandas(run, "bucket long, id long, n long")


def near_signatures(pairs: DataFrame, reps: DataFrame, errors: int, share: float) -> DataFrame:
    """Of the distinct pairs (a, b) those whose signatures and set sizes allow a link."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= share * F.greatest("na", "nb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), -1) for c in ("ga", "gb"))
                yield p.loc[(x != y).sum(1) <= errors, ["a", "b"]]

    return both.select("a", "b", "ga", "gb").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets (id, shingles)."""
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select(*pairs.columns).distinct()


FEW = 30  # a shingle that so many sets hold at most is rare, and such a group small


def prefixes(t: Tables, sets: DataFrame, percent: int, steps: int = 3, bits: int = 19) -> DataFrame:
    """(token, size, large, id, c, far): where sets of different components could meet.

    In one order of all shingles two sets of n and m that share at least
    q = percent * (n + m) / (100 + percent) of them also share one of the first n - q + 1
    and m - q + 1 of each. So the smaller of two sets shows its first shingles for a partner
    of its own size at least, under its class of sizes; the larger one shows, under each class
    of sizes that its partner can have, those that this size leaves. Any order is right; the one by how
    frequent shingles are, rare ones first, shows few that many sets share. Frequencies are
    counted in 2 ** ``bits`` counters, so what is broadcast has a fixed size: rare shingles then
    look as frequent as the average counter, which only blurs the order among them.
    far: how many shingles of a set are rare.
    """
    slots, size = 1 << bits, 1 << min(bits, 12)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            for x in b["shingles"]:
                np.add.at(total, x & (slots - 1), 1)
        if total.any():
            yield pd.DataFrame({"at": np.arange(0, slots, size), "blob": [x.tobytes() for x in total.reshape(-1, size)]})

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "blob": [np.sum([np.frombuffer(x, np.int64) for x in b["blob"]], 0).tobytes()]})

    counts = sets.select("shingles").mapInPandas(count, "at int, blob binary").groupBy("at").applyInPandas(add, "at int, blob binary").collect()
    table = np.zeros(slots, np.int64)
    for r in counts:  # slots / size rows
        table[r["at"] : r["at"] + size] = np.frombuffer(r["blob"], np.int64)
    often, rare = sets.sparkSession.sparkContext.broadcast(table), 2 * int(table.mean()) + FEW

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                made = []
                for k, c, x in zip(*(b[c].iloc[at : at + 200] for c in ("id", "c", "shingles")), strict=True):
                    n, f = len(x), often.value[x & (slots - 1)]
                    q = -(-percent * (n - (-percent * n // 100)) // (100 + percent))  # with the smallest partner
                    first = x[np.lexsort((x, f))][: n - q + 1]
                    made.append(pd.DataFrame({"token": first, "place": np.arange(1, len(first) + 1), "id": k, "c": c, "n": n, "far": int((f <= rare).sum())}))
                if made:
                    yield pd.concat(made, ignore_index=True)

    tokens = t.write(sets.select("id", "c", "shingles").mapInPandas(run, "token long, place int, id long, c long, n int, far int"), "tokens")
    mixed = tokens.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("token")
    n = F.col("n")
    width = np.log(100 / percent) / steps
    size_class = lambda x: F.floor(F.log(x.cast("double")) / width).cast("int")
    last = lambda partner: n - F.ceil(percent * (n + partner) / (100 + percent) - 1e-9) + 1
    least = F.ceil(percent * n / 100 - 1e-9)
    smallest = lambda j: F.greatest(least, F.ceil(F.exp(j * width) * (1 - 1e-9)))
    as_large = F.filter(F.sequence(size_class(least), size_class(n)), lambda j: F.col("place") <= last(smallest(j)))
    as_small = F.when(F.col("place") <= last(n), F.array(size_class(n))).otherwise(F.array().cast("array<int>"))
    role = lambda classes, large: F.transform(classes, lambda j: F.struct(j.alias("size"), F.lit(large).alias("large")))
    shown = F.explode(F.concat(role(as_small, False), role(as_large, True))).alias("x")
    return tokens.join(mixed, "token", "left_semi").select("token", "id", "c", "far", shown).select("token", "x.*", "id", "c", "far")


def mixed_groups(met: DataFrame) -> DataFrame:
    """Groups (token, size) of ``prefixes`` that hold both roles and several components: n, its most common
    component (main) and, as (far, id, c), the member that is nearest to the frequent shingles (centre)."""
    of = met.groupBy("token", "size", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if("large").alias("l"), F.min(F.struct("far", "id", "c")).alias("centre"))
    group = of.groupBy("token", "size").agg(
        F.sum("k").alias("n"), F.sum("l").alias("l"), F.max(F.struct("k", "c"))["c"].alias("main"), F.min("centre").alias("centre"), F.count(F.lit(1)).alias("components")
    )
    return group.where("components > 1 and l > 0 and l < n").select("token", "size", "n", "main", "centre")


def prefix_links(t: Tables, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components c of ``sets`` (id, c, r, n, shingles); enough of them to join all that are linked.

    The centre of a large group is compared with its members first. Then only pairs of different
    components are left, which never needs two members of a group's main component.
    """
    met = t.write(prefixes(t, sets, percent), "met")
    met = t.write(met.join(mixed_groups(met), ["token", "size"]), "groups")
    t.drop("met", "tokens")
    spokes = met.where((F.col("n") > FEW) & (F.col("c") != F.col("centre.c"))).select(F.col("centre.id").alias("a"), F.col("id").alias("b"), F.col("centre.c").alias("ca"), F.col("c").alias("cb"))
    first = t.write(confirmed(spokes.distinct(), sets, percent), "spokes")
    joined = components(t, first.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "spoke-components").withColumnRenamed("id", "c")
    met = met.select("token", "size", "large", "id", "c", "far").join(joined, "c", "left")
    met = t.write(met.withColumn("c", F.coalesce("component", "c")).drop("component"), "joined")
    met = t.write(met.join(mixed_groups(met).select("token", "size", "main"), ["token", "size"]), "open-groups")
    side = lambda large, name: met.where("large" if large else "not large").select("token", "size", "main", F.col("id").alias(name), F.col("c").alias(f"c{name}"))
    small, large = side(False, "a"), side(True, "b").drop("main")
    on = ["token", "size"]
    pairs = small.where("ca != main").join(large, on).where("ca != cb").select("a", "b")
    others = small.where("ca = main").join(side(True, "b").where("cb != main").drop("main"), on).select("a", "b")
    pairs = t.write(pairs.union(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "prefix-pairs")
    return first.select("a", "b").union(t.write(confirmed(pairs, sets, percent), "prefix-links"))


def components(t: Tables, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): smallest id of each connected part, for all ids in ``edges`` (a, b).

    Alternates large-star and small-star steps, which only ever pass on minima, so a hub
    is never gathered; ends when the edges stop changing.
    """
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    e = t.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    was, at = mark(e), 0
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = t.write(small.where("u != v").distinct(), f"{name}-{at + 1}")
        now = mark(e)
        t.drop(f"{name}-{at}")
        at += 1
        if now == was:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        was = now


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    symbols: int = 64,
    errors: int = 27,
    chunks: int = 14,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles; component_id is the smallest key that can be reached, kept
    marks that row. A null or empty text has no shingles and is linked with nothing.
    Keys must be integers; a row with a null key stands alone, with a null component. Rows that
    repeat a key are judged as the texts they hold: the key's component is that of all
    its texts. An empty table gives an empty result.
    """
    t = Tables(docs.sparkSession, "near")
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = t.write(sketch(known, "id", "text", width, symbols), "sketches")
    members = sketches.where("n > 0")
    classes = members.groupBy("s1", "s2").agg(F.min("id").alias("id"))
    reps = t.write(members.join(classes, ["s1", "s2", "id"], "left_semi").dropDuplicates(["id", "s1", "s2"]), "classes")
    keys = keys_of(reps, index_plan(symbols, errors, chunks))
    # most buckets hold one id, which is linked with nothing there; only the others' rows go on
    shared = keys.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("bucket")
    # one band of sizes holds what can be similar, but for its two neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int")
    keys = t.write(keys.withColumn("band", band).join(shared, "bucket", "left_semi"), "keys")
    ends = keys.groupBy("bucket", "band").agg(F.min(F.struct("n", "id")).alias("low"), F.max(F.struct("n", "id")).alias("high"))
    ends = ends.withColumn("next", F.lead("low").over(Window.partitionBy("bucket").orderBy("band")))
    ends = t.write(ends.select("bucket", "band", F.col("low.id").alias("low"), F.col("high.id").alias("high"), F.col("next.id").alias("next")), "ends")
    buckets = t.write(keys.join(ends, ["bucket", "band"]), "buckets")
    t.drop("keys")
    pair = lambda x, y: buckets.where(f"{x} != {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    across = ends.where("next is not null and next != high").select(F.least("high", "next").alias("a"), F.greatest("high", "next").alias("b"))
    stars = pair("id", "low").union(pair("id", "high")).union(across).distinct()
    stars = t.write(near_signatures(stars, reps, errors, percent / 100), "star-pairs")
    ids = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = t.write(full_sets(known, ids, "id", "text", width), "star-sets")
    stars = t.write(confirmed(stars, sets, percent), "stars")
    t.drop("star-sets", "star-pairs", "ends")
    joined = t.write(components(t, stars, "star-components"), "star-classes")
    # buckets that hold several components so far
    placed = buckets.select("bucket", "id").join(joined, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    placed = t.write(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("bucket")
    open_ = t.write(placed.join(mixed, "bucket", "left_semi").select("id", "c").distinct(), "open")
    t.drop("placed", "buckets", "classes")
    sets = t.write(full_sets(known, open_, "id", "text", width), "open-sets")
    edges = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(prefix_links(t, sets, percent))
    # copies of a set reach its class; a key with several texts joins their classes
    copies = members.join(classes.withColumnRenamed("id", "first"), ["s1", "s2"]).where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    final = components(t, edges.union(copies), "components")
    t.drop("open-sets", "groups", "joined", "open-groups", "prefix-pairs")
    made = ("n_shingles", "component_id", "kept")
    sizes = sketches.select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"))
    placed = sizes.join(final, F.col("_id") == F.col("id"), "left")
    placed = placed.select(F.col("_id").alias(key), "n_shingles", F.coalesce("component", "_id").alias("component_id"))
    result = placed.withColumn("kept", F.col(key) == F.col("component_id"))
    null = docs.where(F.col(key).isNull()).select(F.col(key).cast("long").alias(key), F.col(text))
    alone = sketch(null, key, text, width, symbols).select(key, F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return result.unionByName(alone).select(key, *made)

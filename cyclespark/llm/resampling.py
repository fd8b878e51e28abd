"""Importance resampling towards a target distribution (operator 13).

Texts become word n-grams by Arrow kernels: lower-casing, splitting and dictionary encoding of
a batch; shifted dictionary indices form the n-grams, each distinct one is hashed once, by joining
the check sums of its parts, and the gains of the buckets are taken and summed by document.
Spark adds up bucket counts of corpus and target; only the gains, as many as there are buckets, reach
the driver. Ranks come from sorted ranges, never from one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, partitions, unused

#: What stands between words, in lower-cased text (fixed values).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 3
#: Bytes of text that are turned into n-grams at once; more only for a single longer text.
PIECE = 1 << 22


def _through(tables: np.ndarray, sums: np.ndarray, *which: np.ndarray) -> np.ndarray:
    """The linear map that ``tables`` (4, 256), or those of ``which``, hold for each byte of ``sums``."""
    out = np.zeros(len(sums), np.uint32)
    for k in range(4):
        out ^= tables[(*which, k, (sums >> np.uint32(8 * k)) & np.uint32(255))]
    return out


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """How a CRC-32 changes when ``length`` bytes follow it, apart from the check sum of those."""
    if length == 1:
        none = zlib.crc32(b"\0")
        return np.array([[zlib.crc32(b"\0", b << (8 * k)) ^ none for b in range(256)] for k in range(4)], np.uint32)
    one, two = _shift(length // 2), _shift(length - length // 2)
    return np.stack([_through(two, row) for row in one])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each code's place among the distinct ones, the distinct ones); places are 64 bits wide, as they are multiplied by numbers of words."""
    encoded = pa.array(codes).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False)


def ngrams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for each length, text (not decreasing) and bucket of each n-gram."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    flat = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    of = pc.list_parent_indices(lists).filter(real).to_numpy(zero_copy_only=False)
    encoded = flat.filter(real).dictionary_encode()
    word = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    sums, after = (np.array([zlib.crc32(lead + w) for w in words], np.uint32) for lead in (b"", b" "))
    sizes, size = np.unique(np.array([len(w) + 1 for w in words], np.int64), return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in sizes]) if words else np.zeros((0, 4, 256), np.uint32)
    at, gram = np.arange(len(word)), word
    found = [(of, (sums % buckets)[word])]
    for _ in range(1, LONGEST):
        # the n-gram that ends at a word is the shorter one that ended before it in the same text, and the word
        follows = np.flatnonzero((at + 1 < len(of)) & (of[np.minimum(at + 1, len(of) - 1)] == of[at]))
        at, before = at[follows] + 1, gram[follows]
        gram, codes = _distinct(before * len(words) + word[at])
        last = codes % max(len(words), 1)
        sums = _through(tables, sums[codes // max(len(words), 1)], size[last]) ^ after[last]
        found.append((of[at], (sums % buckets)[gram]))
    return np.bincount(of, minlength=len(texts)), found


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``PIECE`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(batch)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of the n-grams of whole texts, repeats counted; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch, "text"):
                for _, bucket in ngrams(piece["text"], buckets)[1]:
                    n += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    each = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket, in thousandths, from the counts of corpus and target, both smoothed by one a bucket."""
    s, t = [0] * buckets, [0] * buckets
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.select("bucket", "n").collect():  # as many rows as buckets at most
            into[bucket] = n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((t_ + 1.0) * all_s / ((s_ + 1.0) * all_t))) for s_, t_ in zip(s, t, strict=True)]


def weighed(docs: DataFrame, gain: list[int], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all but the text) with n_words, n_features and weight, which replace columns of these names."""
    new = ("n_words", "n_features", "weight")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*new, text)]
    buckets, last = len(gain), unused("text", carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            for piece in _pieces(batch, last):
                words, grams = ngrams(piece[last], buckets)
                features, weight = np.zeros((2, len(piece)), np.int64)
                for of, bucket in grams:
                    features += np.bincount(of, minlength=len(piece))
                    weight += np.bincount(of, table[bucket], len(piece)).astype(np.int64)  # whole numbers far below 2^53
                columns = [*piece.columns[:-1], pa.array(words, pa.int64()), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[:-1], *new])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], *[f"{c} long" for c in new]])
    return docs.select(*carry, F.col(text).alias(last)).mapInArrow(run, schema)


def noise(key: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and the key alone (null: no characters)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, order: list[Column], drawn: int, t: Tables) -> DataFrame:
    """Add rank: the first ``drawn`` rows in ``order`` get 1, 2, 3, ...; the others null.

    Sorted ranges are written once, so that a lost task can't number anew; a row's place is its place in its range
    and the sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    rows = scored.withColumn("_row", F.monotonically_increasing_id())  # equal rows can be dealt to several ranges
    ordered = rows.repartitionByRange(partitions(t.spark), *order, "_row").sortWithinPartitions(*order, "_row")
    placed = t.write(ordered.drop("_row").withColumn("_id", F.monotonically_increasing_id()), "placed").withColumn("_p", F.shiftright("_id", 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")
    rank = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")
    return out.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, *, text: str = "text", key: str = "doc_id", target_text: str = "text", carry: list[str] | None = None,
    buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42,
) -> DataFrame:
    """Every row's n_words, n_features, weight, score and rank; drawn are those with a rank.

    Features are runs of 1 to 3 words of the whole text (null: none). A feature's gain is that of its bucket,
    the logarithm of its share in ``target`` over that in ``docs``; the weight sums gains. Gumbel noise of the key makes
    the highest scores a draw without replacement; ``percent`` of the rows with ``least_words`` words are drawn, ties by
    the key (null first), then as the rows come. Repeated rows each count and can each be drawn. The result has the ``carry``
    columns (all but the text) without those of its own names; empty tables give no rows.
    """
    own = ("score", "rank", "_row", "_id", "_p", "_n", "_before")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in own and c != key]
    t = Tables(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets), buckets)
    scored = t.write(weighed(docs, gain, text, [key, *carry]).withColumn("score", F.col("weight") + noise(key, seed)), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    return ranked(scored, [enough.desc(), F.desc("score"), F.asc(key)], drawn, t)


def drawn_documents(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose key was drawn."""
    chosen = resample(docs, target, key=key, carry=[], **how).where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(chosen, docs[key].eqNullSafe(chosen["_drawn"]), "left_semi")

"""Exact substring dedup by difference-cover suffix sorting (operator 9).

Texts are dealt into batches by a hash of their ids. Each 50-byte string is known by its
anchor, the 18-byte gram of smallest hash inside it, so equal strings have equal anchors
at equal places. Anchors that occur in one document only can't belong to a repeated string
and are dropped after one exchange of their hashes. The strings around the others, equal
ones of a batch once, are dealt out by anchor, and each task sorts the suffixes of its
strings by a difference cover: triples at two of three places are sorted and named, the
names are sorted in turn until all are distinct, the remaining suffixes are
merged in by symbol and rank, and neighbours are compared over 50 bytes. Strings of a
class are copies of the one in the document of smallest id.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

LENGTH, GRAM = 50, 18
SPREAD = LENGTH - GRAM + 1  # grams of a string
WIDEST = LENGTH + SPREAD - 1  # bytes of all strings that share an anchor
CHUNK = 1 << 20  # bytes that are worked on at once

_table = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64)
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_up, _down = _powers(_base, CHUNK + 1), _powers(_inverse, CHUNK + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the gram at each place."""
    n = len(data)
    up, down = (_up, _down) if n <= CHUNK else (_powers(_base, n + 1), _powers(_inverse, n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table[data] * up[:n])])
    return _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first string, last string) of each anchor; ``ends``: where the texts in data end."""
    none = tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    h = gram_hashes(data)
    # the smallest hash in SPREAD grams, the leftmost of equal ones: places in the low bits
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(h) - SPREAD + 1], low[SPREAD - width :][: len(h) - SPREAD + 1])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(place))
    inside = starts + LENGTH <= np.repeat(ends, np.diff(ends, prepend=0))[: len(starts)]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return h[place[first]], place[first], first, stop


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, joined bytes, ends) of texts taken together up to CHUNK bytes."""
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size, to = size + len(texts[to]), to + 1
        yield at, np.frombuffer(b"".join(texts[at:to]), np.uint8), np.cumsum([len(t) for t in texts[at:to]])
        at = to


def suffix_ranks(t: np.ndarray) -> np.ndarray:
    """Rank of each suffix of positive symbols (difference cover modulo 3)."""
    n = len(t)
    wide = np.concatenate([t, np.zeros(3, np.int64)])
    k = int(wide.max()) + 1
    two_symbols = wide[:n] * k + wide[1 : n + 1]
    if k * k * (n + k) >= 2**62:  # keeps the keys below in 64 bits
        two_symbols = np.unique(two_symbols, return_inverse=True)[1]
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    distinct, names = np.unique(two_symbols[sample] * k + wide[sample + 2], return_inverse=True)
    if len(distinct) < len(sample):
        # a suffix of the names of places 1 mod 3 runs on into those of 2 mod 3, past a 1
        r = suffix_ranks(np.concatenate([names[: len(one)] + 2, [1], names[len(one) :] + 2]))
        names = np.concatenate([r[: len(one)], r[len(one) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names + 1
    big = int(rank.max()) + 1
    rest = np.arange(0, n, 3)
    # counts of samples below each remaining suffix, by symbol and rank, and by two symbols and rank
    key = wide[rest] * big + rank[rest + 1]
    below = np.searchsorted(np.sort(wide[one] * big + rank[one + 1]), key)
    pair = two_symbols[rest] * big + rank[rest + 2]
    below += np.searchsorted(np.sort(two_symbols[two] * big + rank[two + 2]), pair)
    out = np.empty(n, np.int64)
    at = np.empty(len(rest), np.int64)
    at[np.argsort(key, kind="stable")] = np.arange(len(rest))
    out[rest] = at + below
    free = np.ones(n, bool)
    free[out[rest]] = False
    out[sample[np.argsort(names, kind="stable")]] = np.flatnonzero(free)
    return out


def classes(contexts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, string in it, class) of every LENGTH-byte string; equal strings have one class."""
    rows, width = contexts.shape
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.ones(int((lengths + 1).sum()), np.int64)  # an end sorts before all bytes
    flat[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = contexts[np.arange(width)[None, :] < lengths[:, None]].astype(np.int64) + 2
    rank = suffix_ranks(flat)
    counts = lengths - LENGTH + 1
    context = np.repeat(np.arange(rows), counts)
    string = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = starts[context] + string
    order = np.argsort(rank[place], kind="stable")
    place = place[order]
    # neighbours compared eight bytes at a time
    raw = np.concatenate([flat.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.zeros(len(flat), np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | raw[j : j + len(flat)]
    same = np.ones(len(place) - 1, bool)
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[place + j]
        same &= w[1:] == w[:-1]
    out = np.empty(len(place), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)])
    return context, string, out


_odd = np.random.default_rng(9).integers(0, 2**63, (2, 32), np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct one, number of each row's) of a byte table, ordered by the first eight bytes.

    Rows are told apart by a hash of their words; should two rows share one, bytes decide.
    """
    wide = np.zeros((len(table), -(-table.shape[1] // 8) * 8), np.uint8)
    wide[:, : table.shape[1]] = table
    words = wide.view(np.uint64)
    h = np.zeros(len(table), np.uint64)
    for j in range(words.shape[1]):
        h = _mixed(h ^ (words[:, j] * _odd[0, j]))
    order = np.lexsort((h, words[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words[order, 0][1:] != words[order, 0][:-1])
    lead = order[new]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    if not (words == words[lead][back]).all():
        _, lead, back = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return lead, back


def _blob(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _packed(*arrays: np.ndarray) -> bytes:
    """The same, compressed: for text, an entropy coder halves what the shuffle's codec leaves."""
    return zstandard.ZstdCompressor(level=1).compress(_blob(*arrays))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys by bucket, and where each bucket that occurs starts in it."""
    b = (_mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    found, first = np.unique(b[order], return_index=True)
    return order, found, np.append(first, len(keys))


def _texts(part: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    """The batch in a fixed order, and its texts as UTF-8."""
    part = part.sort_values(["_id", "_text"], kind="stable", ignore_index=True)
    return part, [t.encode() for t in part["_text"]]


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batch: int = 2_000, batch_mb: int = 32) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of each row; kept holds the remaining bytes.

    Texts count as UTF-8 bytes (null: empty). Each byte goes that lies in a 50-byte string which also
    starts in a row with a smaller key; strings are judged on the input. So copies inside
    one document, and rows that share a key, don't affect each other. A row with a null key takes no part
    and stays whole; an empty table gives an empty result. Keys must be whole numbers. A task handles about
    ``batch`` rows or ``batch_mb`` MB of text at a time, whichever is less.
    """
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    known = base.where("_id is not null")
    whole = base.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0)).alias("bytes")).first()
    n = max(1, math.ceil(max(whole["rows"] / batch, whole["bytes"] / (batch_mb << 20))))
    dealt = known.select(F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int").alias("batch"), F.col("_id").cast("long").alias("_id"), "_text")
    dealt = dealt.repartition(min(n, partitions(docs.sparkSession)), "batch")

    def seen(part: pd.DataFrame) -> pd.DataFrame:
        """Distinct anchors of a batch by bucket; the low bit tells that several rows hold one."""
        number, (part, texts) = int(part["batch"].iloc[0]), _texts(part)
        hs, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, data, ends in chunks(texts):
            h, place, _, _ = anchors(data, ends)
            hs.append(h & ~np.uint64(1))
            rows.append(first + np.searchsorted(ends, place, side="right"))
        h, row = np.concatenate(hs), np.concatenate(rows)
        order = np.argsort(h, kind="stable")  # rows ascend already
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        many = row[np.append(start[1:], len(h)) - 1] != row[start] if len(h) else np.empty(0, bool)
        h = h[start] | many.astype(np.uint64)
        order, found, at = _dealt(h & ~np.uint64(1), n)
        blobs = [_blob(h[order[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        return pd.DataFrame({"bucket": found.astype(np.int32), "batch": np.int32(number), "blob": blobs})

    def repeated(part: pd.DataFrame) -> pd.DataFrame:
        """For each batch its anchors that several rows hold."""
        lists = [pickle.loads(b)[0] for b in part["blob"]]
        h = np.concatenate(lists)
        plain = h & ~np.uint64(1)
        values, back, count = np.unique(plain, return_inverse=True, return_counts=True)
        many = count > 1
        np.logical_or.at(many, back[(h & np.uint64(1)) > 0], True)
        out, at = [], 0
        for x in lists:
            out.append(_blob(plain[at : at + len(x)][many[back[at : at + len(x)]]]))
            at += len(x)
        return pd.DataFrame({"batch": part["batch"].astype(np.int32), "blob": out})

    def contexts(part: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        """Strings around repeated anchors, equal ones once, with the places where they stand."""
        columns = ["bucket", "batch", "blob"]
        if not len(part) or not len(marks):
            return pd.DataFrame(columns=columns)
        number, (part, texts) = int(part["batch"].iloc[0]), _texts(part)
        asked = np.unique(np.concatenate([pickle.loads(b)[0] for b in marks["blob"]]))
        ids = part["_id"].to_numpy(np.int64)
        found: list[tuple] = []
        for first, data, ends in chunks(texts):
            h, place, a, z = anchors(data, ends)
            h = h & ~np.uint64(1)
            at = np.minimum(np.searchsorted(asked, h), max(len(asked) - 1, 0))
            hit = asked[at] == h if len(asked) else np.zeros(len(h), bool)
            h, place, a, z = h[hit], place[hit], a[hit], z[hit]
            local = np.searchsorted(ends, a, side="right")
            size = z - a + LENGTH
            wide = np.concatenate([data, np.zeros(WIDEST, np.uint8)])
            bytes_ = np.lib.stride_tricks.sliding_window_view(wide, WIDEST)[a].copy()
            bytes_[np.arange(WIDEST)[None, :] >= size[:, None]] = 0
            begin = a - np.where(local > 0, ends[local - 1], 0)
            found.append((h, (place - a).astype(np.uint8), size.astype(np.uint8), bytes_, (first + local).astype(np.int32), begin.astype(np.int32)))
        h, off, size, bytes_, row, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(h):
            return pd.DataFrame(columns=columns)
        whole = np.concatenate([h[:, None].view(np.uint8), off[:, None], size[:, None], bytes_], 1)
        lead, back = distinct_rows(whole)
        h, whole = h[lead], whole[lead]
        order, buckets, at = _dealt(h, n)
        bucket_of = np.empty(len(h), np.int64)
        place_in = np.empty(len(h), np.int64)
        for j, (x, y) in enumerate(zip(at, at[1:], strict=False)):
            bucket_of[order[x:y]], place_in[order[x:y]] = j, np.arange(y - x)
        own = bucket_of[back]
        spots = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[spots], np.arange(len(buckets) + 1))
        blobs = []
        for j, (x, y) in enumerate(zip(at, at[1:], strict=False)):
            s = spots[cut[j] : cut[j + 1]]
            blobs.append(_packed(whole[order[x:y]], place_in[back[s]].astype(np.int32), row[s], begin[s], ids[row[s]]))
        return pd.DataFrame({"bucket": buckets.astype(np.int32), "batch": np.int32(number), "blob": blobs})[columns]

    def judged(part: pd.DataFrame) -> pd.DataFrame:
        """For each batch the strings that also start in a row of smaller key: row, first string, bits."""
        parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(b)) for b in part["blob"]]
        records = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *[len(p[0]) for p in parts]])
        lead, back = distinct_rows(records)  # those of one anchor are neighbours
        table = records[lead]
        spot = np.concatenate([back[p[1] + s] for p, s in zip(parts, shift, strict=False)])
        ids = np.concatenate([p[4] for p in parts])
        least = np.full(len(table), np.iinfo(np.int64).max)
        np.minimum.at(least, spot, ids)
        top = np.full(len(table), np.iinfo(np.int64).min)
        np.maximum.at(top, spot, ids)
        anchor = np.ascontiguousarray(table[:, :8]).view(np.uint64).ravel()
        size = table[:, 9].astype(np.int64)
        counts = size - LENGTH + 1
        starts = np.cumsum(counts) - counts
        first = np.repeat(least, counts)  # smallest key by string
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        group = np.diff(np.append(edge, len(anchor)))
        # a context that is alone with its anchor needs no sorting
        shared = np.repeat(group > 1, group)
        todo = np.flatnonzero(shared)
        limit = max(1, CHUNK // (WIDEST + 1))
        at = 0
        while at < len(todo):
            to = min(len(todo), at + limit)
            while to < len(todo) and anchor[todo[to]] == anchor[todo[to - 1]]:
                to += 1
            own = todo[at:to]
            context, string, kind_ = classes(table[own, 10:], size[own])
            low = np.full(int(kind_.max()) + 1, np.iinfo(np.int64).max)
            place = starts[own][context] + string
            np.minimum.at(low, kind_, first[place])
            first[place] = low[kind_]
            at = to
        out, done = [], 0
        for p, s in zip(parts, shift, strict=False):
            rec = back[p[1] + s]
            bits = np.zeros(len(rec), np.uint64)
            for j in range(SPREAD):
                has = j < counts[rec]
                bits |= np.where(has & (first[np.minimum(starts[rec] + j, len(first) - 1)] < p[4]), np.uint64(1) << np.uint64(j), np.uint64(0))
            hit = bits > 0
            out.append(_blob(p[2][hit], p[3][hit], bits[hit]))
            done += len(rec)
        return pd.DataFrame({"batch": part["batch"].astype(np.int32), "blob": out})

    def removed(part: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        columns = ["_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not len(part):
            return pd.DataFrame(columns=columns)
        part, texts = _texts(part)
        found = [pickle.loads(b) for b in marks["blob"]]
        row, begin, bits = (np.concatenate([np.empty(0, t), *[f[i] for f in found]]).astype(t) for i, t in enumerate((np.int32, np.int32, np.uint64)))
        order = np.argsort(row, kind="stable")
        row, begin, bits = row[order], begin[order], bits[order]
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        rows = []
        for i, t in enumerate(texts):
            if at[i] == at[i + 1]:
                rows.append((len(t), 0, 0, t))
                continue
            edge = np.zeros(len(t) + 1, np.int32)
            b, m = begin[at[i] : at[i + 1]].astype(np.int64), bits[at[i] : at[i + 1]]
            for j in range(SPREAD):
                s = b[(m >> np.uint64(j)) & np.uint64(1) > 0] + j
                np.add.at(edge, s, 1)
                np.add.at(edge, s + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
        out = pd.DataFrame(rows, columns=columns[1:])
        out.insert(0, "_id", part["_id"].to_numpy())
        return out

    blobs = "batch int, blob binary"
    marks = dealt.groupBy("batch").applyInPandas(seen, f"bucket int, {blobs}").groupBy("bucket").applyInPandas(repeated, blobs)
    strings = dealt.groupBy("batch").cogroup(marks.groupBy("batch")).applyInPandas(contexts, f"bucket int, {blobs}")
    verdicts = strings.groupBy("bucket").applyInPandas(judged, blobs)
    result = dealt.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInPandas(removed, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    alone = base.where("_id is null").select(
        F.lit(None).cast("long").alias("_id"), F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("_text", "UTF-8").alias("kept")
    )
    return result.unionByName(alone).select(F.col("_id").cast(kind).alias(key), "n_bytes", "n_removed", "n_spans", "kept")

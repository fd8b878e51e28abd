"""Byte-level BPE by speculation and verification (operator 4).

A word's tokens are proposed by greedy longest match. A sequence of tokens is the exact
encoding if each adjacent pair is: encoding the two tokens' joined bytes gives the same
two tokens again. The pairs of all new words of a batch are tested at once with sorted
arrays; only words with a failing pair go through exact merging. Words are kept in a
bounded cache of the Python worker, so that frequent ones cost one lookup.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The library's pre-tokeniser for byte-level BPE, with white space spelled out (fixed values).
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: A blank before a visible character always begins a word; elsewhere it may not.
_UNEVEN = re.compile(r" (?:[\s\x85\xa0]|$)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


ENTRY = 200  # bytes of a cache entry besides its characters and ids


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file; ``cache_words`` and ``cache_mb`` bound its memory."""

    def __init__(self, path: str, cache_words: int = 500_000, cache_mb: int = 128):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.id_of = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in self.id_of.items():
            self.bytes_of[i] = t
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.added = added
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        # tokens by age: bytes first, then in the order in which merges make them
        top = len(self.bytes_of)
        self.age = np.full(top, -1, np.int64)
        self.age[self.byte_id] = range(256)
        self.merge: dict[int, tuple[int, int]] = {}
        left, right, codes = list(range(256)), list(range(256)), []
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[(x << 32) | y] = (rank, made)
            self.age[made] = 256 + rank
            left.append(int(self.age[x]))
            right.append(int(self.age[y]))
            codes.append((left[-1] << 32) | right[-1])
        self.left, self.right = np.array(left), np.array(right)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ages = np.array(codes)[order], order + 256
        # greedy matching proposes only tokens whose own bytes encode to them
        self.stable = {t: i for t, i in self.id_of.items() if self.exact(t) == [i]}
        self.reach: dict[bytes, int] = {}  # longest token by its first two bytes
        for t in self.stable:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.known: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.cache_bytes, self.held = cache_words, cache_mb << 20, 0

    def exact(self, word: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        ids, merge, none = [self.byte_id[b] for b in word], self.merge, (1 << 60, -1)
        if len(ids) > 200:
            return self._exact_long(ids)
        best = [merge.get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while best and (least := min(best)) is not none:
            i = best.index(least)
            ids[i : i + 2] = [least[1]]
            del best[i]
            if i < len(best):
                best[i] = merge.get((ids[i] << 32) | ids[i + 1], none)
            if i:
                best[i - 1] = merge.get((ids[i - 1] << 32) | ids[i], none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length in O(n log n)."""
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := merge.get((ids[i] << 32) | ids[j])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, stable, reach = [], 0, len(word), self.stable, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at : at + 2], 1))
            while (i := stable.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether the two can stand side by side.

        A pair falls if, on the way from bytes to the two tokens, a merge across their
        border would have come before a merge inside them. The younger of the two
        tokens that touch at the border is undone, again and again, for all pairs at once.
        """
        a, b = self.age[first], self.age[second]
        fits, where = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 60)  # merges across the border before this age destroy the pair
        while len(where):
            at = np.minimum(np.searchsorted(self.pair_codes, (a << 32) | b), len(self.pair_codes) - 1)
            across = np.where(self.pair_codes[at] == ((a << 32) | b), self.pair_ages[at], 1 << 61)
            bad = across < limit
            fits[where[bad]] = False
            # the left one is undone if it is younger; of equal ages the left one merged first
            undo_left = a > b
            stuck = np.maximum(a, b) < 256
            live = ~bad & ~stuck
            limit = np.where(undo_left, a, b + 1)[live]
            a, b, undo_left, where = a[live], b[live], undo_left[live], where[live]
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return fits

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        proposed = [self.greedy(w) for w in words]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False  # pairs across words
        where = np.flatnonzero(inner)
        bad = where
        if len(where):
            pairs, back = np.unique((flat[where] << 32) | flat[where + 1], return_inverse=True)
            bad = where[~self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]
        for k in np.unique(np.searchsorted(ends, bad, side="right")).tolist():
            proposed[k] = self.exact(words[k])
        return [np.array(p, "<u4").tobytes() for p in proposed]

    def _chunks(self, text: str) -> list[str]:
        """Parts of ``text`` that are tokenised independently of each other."""
        if not text:
            return []
        if _UNEVEN.search(text):
            return _WORD.findall(text)
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + x for x in rest]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cache = self.cache
        if len(cache) > self.cache_words or self.held > self.cache_bytes:
            cache.clear()
            self.known.clear()
            self.held = 0
        parts: list[list[str | int]] = []
        for t in texts:
            if self.specials is not None and any(s in t for s in self.added):
                got: list[str | int] = []
                for k, piece in enumerate(self.specials.split(t)):
                    got += [self.added[piece]] if k % 2 else self._chunks(piece)
                parts.append(got)
            else:
                parts.append(self._chunks(t))
        chunks = {c for p in parts for c in p if c not in cache}
        todo = {c: _WORD.findall(c) for c in chunks if isinstance(c, str)}
        known = self.known
        if new := list({w for ws in todo.values() for w in ws if w not in known}):
            known.update(zip(new, self.words([w.encode() for w in new]), strict=True))
            self.held += sum(len(w) + len(known[w]) for w in new) + ENTRY * len(new)
        for c in chunks:
            cache[c] = b"".join(map(known.__getitem__, todo[c])) if c in todo else np.array([c], "<u4").tobytes()
            self.held += ENTRY + len(cache[c]) + (len(c) if c in todo else 0)
        return [b"".join(map(cache.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_open: dict[str, SpeculativeBpe] = {}


def tokenizer(path: str) -> SpeculativeBpe:
    if path not in _open:
        _open[path] = SpeculativeBpe(path)
    return _open[path]


def _with(df: DataFrame, source: str, name: str, kind: str, fn) -> DataFrame:
    rest = [c for c in df.columns if c not in (source, name)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, max(len(b), 1), 1000):  # bounds what a batch of long texts holds at once
                part = b.iloc[at : at + 1000]
                yield part[rest].assign(**{name: fn(part[source])})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in rest], f"`{name}` {kind}"])
    return df.select(*rest, source).mapInPandas(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace ``text`` by ``ids``: little-endian unsigned 32-bit integers as binary.

    The ids are those of the tokenizers library for the vocabulary file ``path`` without
    special tokens added, special strings in a text included. A null text counts as
    empty and has no ids; rows are independent, so order, copies and empty tables need no
    care. Other columns must be of types that Arrow carries.
    """
    return _with(df, text, ids, "binary", lambda s: tokenizer(path).encode(s.fillna("")))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace ``ids`` by the text they stand for, special tokens included; null: empty."""
    return _with(df, ids, text, "string", lambda s: [tokenizer(path).decode(x or b"") for x in s])


def round_trip(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Digests of the ids and of the text decoded from them, a row a document."""
    # pandas turns whole numbers beside a null into floats: keys travel as strings
    ids = encode(docs.select(F.col(key).cast("string").alias("_key"), "text"), path)
    ids = ids.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    back = decode(ids, path).withColumn("decoded_sha256", F.sha2(F.col("text"), 256))
    return back.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), "n_tokens", "ids_sha256", "decoded_sha256")

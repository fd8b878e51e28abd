"""Best-fit packing of documents into fixed-length sequences (operator 5).

Tokens, documents and attention cost (the sum of squared lengths) are the capacities of
a sequence. Pieces are dealt by hash into blocks of bounded size; in each block they go,
largest first, to the open sequence that fits under every capacity and is left with the
smallest weighted residual norm (or dot product with the piece's demand).
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import cut

#: Control characters that str.split() takes for white space and the tokenizer doesn't.
_ODD = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[\t-\r \x85\xa0  -     　]+")


class WordTokenizer:
    """The tokenizers library behind a bounded cache of white-space separated words.

    Right for tokenizers that drop white space and never join words across it.
    """

    def __init__(self, path: str, cache_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.marks = {c: self._ids([c])[0] for c in ",.;:!?"}
        self._plain_merges(path)

    def _plain_merges(self, path: str) -> None:
        """The vocabulary for tiktoken, which merges words of letters several times faster.

        A zero byte stands for the end of a word; it joins the last byte first, as the
        tokenizer's suffix does. Merging by the rank of the joined bytes is merging by the
        list of pairs: a token's bytes, with no merge across their ends, come together as they do alone.
        """
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]

        def spelt(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + b"\0" * end

        ranks = {bytes([c]): c for c in range(256)} | {bytes([c, 0]): 256 + c for c in range(256)}
        for k, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            ranks[spelt(x + y)] = 512 + k
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.id_of_rank = np.zeros(512 + len(model["merges"]), "<u4")
        self.ends = np.zeros(len(self.id_of_rank), bool)
        for token, i in model["vocab"].items():
            r = ranks[spelt(token)]
            self.id_of_rank[r], self.ends[r] = i, token.endswith(suffix)

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of_letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, many of them encoded as one text."""
        lines = ["\0".join([*words[i : i + 5000], ""]) for i in range(0, len(words), 5000)]
        ranks = [self.fast.encode_to_numpy(x, disallowed_special=()) for x in lines]
        whole = np.concatenate([np.empty(0, np.uint32), *ranks])
        to = 4 * (np.flatnonzero(self.ends[whole]) + 1)
        raw = self.id_of_rank[whole].tobytes()
        return [raw[a:b] for a, b in zip([0, *to.tolist()], to.tolist(), strict=False)]

    def _learn(self, words: list[str]) -> None:
        """Put new words into the cache. A word of Latin letters, in lower case and less one
        closing mark, is looked up by itself: the tokenizer lowers case and splits off marks."""
        plain, marks, other, parts = self.plain, self.marks, [], []
        if len(plain) > self.cache_words:
            plain.clear()
        for w in words:
            bare = (w[:-1] if w[-1] in marks else w).lower()
            if bare.isalpha() and (bare.isascii() or max(bare) < "\u0250"):
                parts.append((w, bare))
            else:
                other.append(w)
        new = list({a for _, a in parts if a not in plain})
        plain.update(zip(new, self._ids_of_letters(new), strict=True))
        self.cache.update([(w, plain[a] if w[-1] not in marks else plain[a] + marks[w[-1]]) for w, a in parts])
        self.cache.update(zip(other, self._ids(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        words = [[w for w in _SPACES.split(t) if w] if _ODD.search(t) else t.split() for t in texts]
        seen: set[str] = set()
        for ws in words:
            seen.update(ws)
        if new := list(seen.difference(cache)):
            self._learn(new)
        return [b"".join(map(cache.__getitem__, ws)) for ws in words]


_open: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of at most ``size``: key, piece, start, length, ids (little-endian 32-bit, binary).

    A document's tokens end with ``end_id``; only longer ones are cut. A null text counts
    as empty: one piece that holds ``end_id`` alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _open:
            _open[path] = WordTokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                encoded = _open[path].encode(part["_text"].fillna("").tolist())
                rows = [
                    (k, start // size, start, min(size, len(ids) // 4 - start), ids[4 * start : 4 * (start + size)])
                    for k, ids in zip(part["_key"], [x + end for x in encoded], strict=True)
                    for start in range(0, len(ids) // 4, size)
                ]
                yield pd.DataFrame(rows, columns=["_key", "piece", "start", "length", "ids"])

    # pandas turns whole numbers beside a null into floats: keys travel as strings
    cuts = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    cuts = cuts.mapInPandas(run, "_key string, piece int, start long, length long, ids binary")
    return cuts.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), "piece", "start", "length", "ids")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece over a capacity by itself gets a bin of its own."""
    n = len(lengths)
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1)
    share = demand / cap
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -(share * w).sum(1)))
    left = np.empty((256, 3))  # residual shares of the open bins
    ids, fill = np.empty(256, np.int64), []
    m, least = 0, share.min(0) if n else 0
    eps = 1e-12
    for i in order:
        d = share[i]
        best = -1
        if m:
            after = left[:m] - d
            ok = np.flatnonzero(after.min(1) >= -eps)
            if len(ok):
                value = (after[ok] ** 2) @ w if score == "norm" else left[ok] @ (w * d)
                best = int(ok[value.argmin()])
        if best < 0:
            if m == len(left):
                left, ids = np.resize(left, (2 * m, 3)), np.resize(ids, 2 * m)
            left[m], ids[m], best, m = 1.0, len(fill), m, m + 1
            fill.append(0)
        b = ids[best]
        bins[i], offsets[i] = b, fill[b]
        fill[b] += int(lengths[i])
        left[best] -= d
        if (left[best] < least - eps).any():  # nothing fits any more: closed
            m -= 1
            left[best], ids[best] = left[m], ids[m]
    return bins, offsets


def pack(
    parts: DataFrame,
    *,
    size: int = 2048,
    max_documents: int = 2048,
    max_attention: float = 2048.0**2,
    weights: tuple[float, float, float] = (1.0, 0.3, 0.3),
    score: str = "norm",
    block: int = 10_000,
) -> DataFrame:
    """Add sequence_id and offset to rows that have ``length`` (1 to ``size``).

    Rows are written once with a number each and dealt into blocks of about ``block`` by a hash
    of the number, so copies of a row don't meet and a lost task is redone alike. A block
    wastes about one sequence.
    Weights (of tokens, documents, attention cost) order the pieces and choose the sequence among
    those that fit; all three capacities always hold, but for a piece that exceeds one of them alone. Copies of rows are packed each; an
    empty table gives an empty result.
    """
    carry = [c for c in parts.columns if c not in ("sequence_id", "offset", "_number", "_block")]
    numbered = cut(parts.select(*carry, F.monotonically_increasing_id().alias("_number")), "pieces")
    blocks = max(1, math.ceil(numbered.count() / block))
    keyed = numbered.withColumn("_block", F.pmod(F.xxhash64("_number"), F.lit(blocks)))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in parts.dtypes if c in carry], "sequence_id long, offset long"])

    def run(key: tuple, b: pa.Table) -> pa.Table:
        b = b.sort_by("_number")
        bins, offsets = best_fit(b["length"].to_numpy(), (size, max_documents, max_attention), weights, score)
        out = b.select(carry).append_column("sequence_id", pa.array((key[0].as_py() << 32) | bins, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return keyed.groupBy("_block").applyInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str, *, key: str = "doc_id", **capacities) -> DataFrame:
    """Pieces of all documents with a digest of their ids, packed. The ids stay with ``pieces``."""
    cuts = pieces(docs, path, key=key).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cuts, **capacities)

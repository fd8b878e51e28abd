"""Maximum inner product search with score-aware quantisation (operator 2).

Vectors are coded by four bits for each pair of dimensions. The codebooks minimise an
anisotropic loss, which weighs the residual parallel to the vector more than the
orthogonal one, as only that part moves large inner products. Queries scan table sums
over the codes, block by block, and the best codes of each block are ranked again by
exact inner products of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODES = 16


@dataclass
class Quantiser:
    """Codebooks: (subspaces, 16, dims). Its size depends on the dimension only."""

    books: np.ndarray
    ratio: float  # weight of the parallel residual over the orthogonal one

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        wide = np.zeros((len(x), m * d))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), m, d)

    def _direction(self, parts: np.ndarray) -> np.ndarray:
        return parts / np.maximum(np.sqrt((parts**2).sum((1, 2), keepdims=True)), 1e-30)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: each subspace in turn takes the code of least loss."""
        parts = self.split(x)
        u, m = self._direction(parts), self.books.shape[0]
        flat = np.stack([((parts[:, j, None] - self.books[j]) ** 2).sum(2) for j in range(m)], 1)
        out = flat.argmin(2)
        along = np.stack([((self.books[j][out[:, j]] - parts[:, j]) * u[:, j]).sum(1) for j in range(m)], 1)
        for _ in range(sweeps):
            for j in range(m):
                rest = along.sum(1) - along[:, j]
                proj = u[:, j] @ self.books[j].T - (parts[:, j] * u[:, j]).sum(1)[:, None]
                loss = flat[:, j] + (self.ratio - 1) * (rest[:, None] + proj) ** 2
                out[:, j] = loss.argmin(1)
                along[:, j] = np.take_along_axis(proj, out[:, j, None], 1)[:, 0]
        return out

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre becomes the least-loss point of the vectors that use it."""
        parts = self.split(x)
        u, d = self._direction(parts), parts.shape[2]
        along = np.stack([((self.books[j][codes[:, j]] - parts[:, j]) * u[:, j]).sum(1) for j in range(len(self.books))], 1)
        for j, book in enumerate(self.books):
            rest = along.sum(1) - along[:, j]
            for k in range(CODES):
                own = codes[:, j] == k
                if own.any():
                    v, p = u[own, j], parts[own, j]
                    a = own.sum() * np.eye(d) + (self.ratio - 1) * v.T @ v
                    b = p.sum(0) + (self.ratio - 1) * v.T @ ((v * p).sum(1) - rest[own])
                    book[k] = np.linalg.solve(a, b)
            along[:, j] = ((book[codes[:, j]] - parts[:, j]) * u[:, j]).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query, the sum for each byte of two codes: (queries, bytes, 256)."""
        parts = self.split(q)
        one = np.einsum("qmd,mkd->qmk", parts, self.books)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], 1)
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES).astype(np.float32)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
        return (codes[:, ::2] * CODES + codes[:, 1::2]).astype(np.uint8)


def train(sample: np.ndarray, *, dims: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> Quantiser:
    """Fit codebooks on ``sample``. ``threshold`` is the cosine from which inner products matter."""
    d = sample.shape[1]
    m = math.ceil(d / dims)
    rng = np.random.default_rng(seed)
    start = sample[rng.integers(0, len(sample), CODES)]
    model = Quantiser(np.zeros((m, CODES, dims)), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    model.books = np.ascontiguousarray(model.split(start).transpose(1, 0, 2)).copy()
    for _ in range(rounds):
        model.refit(sample, model.codes(sample, 1))
    return model


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors of finite components, not all zero, and of the table's usual dimension."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~x.isin(float("nan"), float("inf"), float("-inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine & F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v"))


def nearest(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    keep: int = 120,
    sample: int = 10_000,
    block: int = 8_192,
    query_block: int = 2_048,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``.

    The model is fitted on at most ``sample`` vectors, the first by a hash of their ids;
    all vectors are coded and searched. Each block of ``block`` vectors meets each block
    of ``query_block`` queries in a task of its own, ranks its ``keep`` best codes and all
    that tie with the last of them again by exact products, and hands on ``k``.

    Returns query_id, rank (from 1), vec_id, score. Null, zero and non-finite vectors, null
    ids and vectors of an unusual dimension take no part. A query's own id is no
    candidate; of copies of one id, the smallest vector asks, all are candidates. Ties go
    to the smaller id. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    out = f"query_id {dict(df.dtypes)[key]}, rank int, vec_id {dict(df.dtypes)[key]}, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    d = sizes[0]["d"]
    rows = rows.where(F.size("v") == d)
    n = rows.count()
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    model = spark.sparkContext.broadcast(train(np.array(fitted["v"].tolist())))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n / every / query_block))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                packed = Quantiser.packed(model.value.codes(np.array(b["v"].tolist())))
                yield b.assign(code=[x.tobytes() for x in packed])

    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    coded = rows.mapInPandas(code, f"id {dict(rows.dtypes)['id']}, v array<double>, code binary")
    base = coded.withColumns({"b": own(blocks), "q": numbers(query_blocks)})
    queries = asked.withColumns({"q": own(query_blocks), "b": numbers(blocks)})

    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(q) or not len(b):
            return pd.DataFrame(columns=columns)
        b = b.sort_values("id", kind="stable")
        ids, vectors = b["id"].to_numpy(), np.array(b["v"].tolist())
        codes = np.ascontiguousarray(np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1).T)
        found = []
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            asked_v = np.array(part["v"].tolist())
            tables = model.value.tables(asked_v)
            for query, v, table in zip(part["id"], asked_v, tables, strict=True):
                rough = table[0].take(codes[0])
                for t, c in zip(table[1:], codes[1:], strict=True):
                    rough += t.take(c)
                rough[ids == query] = -np.inf
                # with all that tie with the last one kept, so equal vectors go by id
                best = np.flatnonzero(rough >= np.partition(rough, len(rough) - keep)[len(rough) - keep]) if len(rough) > keep else np.arange(len(rough))
                best = best[ids[best] != query]
                exact = (vectors[best] * v).sum(1)
                best, exact = (x[np.lexsort((ids[best], -exact))[:k]] for x in (best, exact))
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": exact}))
        return pd.concat(found, ignore_index=True)

    kind = dict(rows.dtypes)["id"]
    hits = queries.groupBy("b", "q").cogroup(base.groupBy("b", "q")).applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

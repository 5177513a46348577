"""Approximate nearest neighbours by largest inner product.

Score-aware (anisotropic) product quantisation: a code's loss weighs the residual along the vector
``eta`` times as much as the residual across it, since that part moves large inner products. Codes
have four bits; a query's tables give approximate scores of a whole block, the best of each block are
scored exactly on the original vectors, and the best of all blocks are the answer.

The codebooks are fitted on at most ``SAMPLE`` vectors (smallest hash of the id); every row is
encoded and scanned. Vectors keep their element type on the way and stand in blocks of at most
``BLOCK_BYTES``, each in a task of its own with the queries streaming past it, so a task's memory does
not grow with the table, and a query travels once for each block.

Defined results: vectors that are null, zero, of another than the most common length, or hold null
or non-finite components take no part; ties go to the smaller vec_id; fewer candidates than asked for
are all returned; a query row is no candidate of its own, but every other row is, also one with its id
or vector; equal query rows are one query, and query rows of one id with different vectors are ranked
each by itself; a null vec_id takes no part; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CODES, WIDTH = 8192, 16, 2
BLOCK_BYTES, LEAST = 64 << 20, 8192  # vectors of a block: bytes at most, and rows at least where there are more tasks than blocks
RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class AnisotropicCodebook:
    """Centroids [subspaces, 16, WIDTH] and the weight of parallel residuals."""

    centroids: np.ndarray
    eta: float

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """[n, subspaces (even), WIDTH], zero-padded."""
        n, d = x.shape
        m = -(-d // WIDTH)
        m += m & 1
        out = np.zeros((n, m * WIDTH), np.float32)
        out[:, :d] = x
        return out.reshape(n, m, WIDTH)

    @classmethod
    def fit(cls, x: np.ndarray, *, threshold: float = 0.2, rounds: int = 5, seed: int = 7) -> AnisotropicCodebook:
        """Alternate between codes and centroids, both under the anisotropic loss."""
        d, rng = x.shape[1], np.random.default_rng(seed)
        xs = cls._split(x)
        m = xs.shape[1]
        book = cls(np.stack([xs[rng.integers(0, len(xs), CODES), j] for j in range(m)]), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
        for _ in range(rounds):
            codes = book.encode(x)
            us = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
            c = book.centroids.copy()
            picked = np.stack([c[j][codes[:, j]] for j in range(m)], axis=1)
            along = ((xs - picked) * us).sum(-1)  # parallel residual of each subspace
            total = along.sum(1)
            for j in range(m):
                other, u, w = total - along[:, j], us[:, j], book.eta - 1
                target = xs[:, j] + w * (other + (xs[:, j] * u).sum(-1))[:, None] * u
                for k in range(CODES):
                    mine = codes[:, j] == k
                    if not mine.any():
                        c[j, k] = xs[rng.integers(0, len(xs)), j]
                        continue
                    a = mine.sum() * np.eye(WIDTH) + w * u[mine].T @ u[mine]
                    c[j, k] = np.linalg.solve(a, target[mine].sum(0))
                new = ((xs[:, j] - c[j][codes[:, j]]) * u).sum(-1)
                total += new - along[:, j]
                along[:, j] = new
            book = cls(c, book.eta)
        return book

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes [n, subspaces] by coordinate descent on the loss of the whole vector."""
        xs = self._split(x)
        us = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        n, m, _ = xs.shape
        codes = np.zeros((n, m), np.uint8)
        square = np.stack([((xs[:, j, None] - self.centroids[j]) ** 2).sum(-1) for j in range(m)], axis=1)
        along = np.stack([(xs[:, j] * us[:, j]).sum(-1)[:, None] - us[:, j] @ self.centroids[j].T for j in range(m)], axis=1)
        codes[:] = square.argmin(-1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None].astype(np.int64), 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                other = total - along[rows, j, codes[:, j]]
                best = (square[:, j] + (self.eta - 1) * (other[:, None] + along[:, j]) ** 2).argmin(-1)
                codes[:, j] = best
                total = other + along[rows, j, best]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Per query, inner products with the centroids, for two neighbouring codes at once: [q, subspaces/2, 256]."""
        qs = self._split(queries)
        t = np.einsum("qjw,jkw->qjk", qs, self.centroids).astype(np.float32)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(qs), -1, CODES * CODES)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte, a row per pair of subspaces: [subspaces/2, n]."""
    return np.ascontiguousarray((codes[:, 0::2] * CODES + codes[:, 1::2]).T)


def scan(packed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Approximate scores of a block for one query."""
    out = table[0][packed[0]]
    for p in range(1, len(packed)):
        out += table[p][packed[p]]
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest, ties to the smaller index."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    return np.concatenate([above, np.flatnonzero(scores == cut)[: k - len(above)]])


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, embedding of floats, or doubles if it holds other numbers) of the rows that take part, their length and number."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    v = v.filter(finite)
    lengths = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (lengths[0].d, lengths[0].n) if lengths else (0, 0)
    return v.filter(F.size("embedding") == d), d, n


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, rerank: int = 160, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows."""
    spark = vectors.sparkSession
    v, d, n = valid_vectors(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["embedding"].combine_chunks()
    book = AnisotropicCodebook.fit(_matrix(sample, d).astype(np.float32))
    width = 4 if v.schema["embedding"].dataType.simpleString() == "array<float>" else 8
    blocks = max(-(-n * d * width // block_bytes), min(spark.sparkContext.defaultParallelism, n // LEAST), 1)
    rows = v.select((F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0).cast("long").alias("query"))
    asked = v.filter(is_query).dropDuplicates(["vec_id", "embedding"]).withColumn("query", F.xxhash64("embedding"))
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding", "query")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, packed, ids, exact = None, [], None, None, None

        def finish() -> None:
            """Encode the held vectors of the block, in order of their ids."""
            nonlocal held, packed, ids, exact
            ids, exact = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(ids, kind="stable")
            ids, exact, held = ids[order], exact[order], []
            parts = [pack_codes(book.encode(exact[i : i + LEAST].astype(np.float32))) for i in range(0, len(exact), LEAST)]
            packed = np.concatenate(parts, axis=1)

        for batch in batches:
            block, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, packed, ids = block[a], [], None, None
                vec_ids, x = batch.column(2)[a:b].to_numpy(zero_copy_only=False), _matrix(batch.column(3)[a:b], d)
                numbers = batch.column(4)[a:b].to_numpy(zero_copy_only=False)
                if kind[a] == 0:
                    held.append((vec_ids, x))
                    continue
                if held:
                    finish()
                if ids is None:
                    continue
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in range(0, len(x), 64):
                    tables = book.tables(x[i : i + 64].astype(np.float32))
                    for q, table in enumerate(tables, i):
                        c = best(scan(packed, table), rerank + 1)
                        own = np.flatnonzero(ids[c] == vec_ids[q])
                        own = own[(exact[c[own]] == x[q]).all(axis=1)]
                        c = np.delete(c, own[:1])
                        s = exact[c].astype(np.float64) @ x[q].astype(np.float64)
                        top = np.lexsort((ids[c], -s))[:k]
                        out[0].append(np.full(len(top), vec_ids[q]))
                        out[1].append(ids[c[top]])
                        out[2].append(s[top])
                        out[3].append(np.full(len(top), numbers[q]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score", "query"])

    dealt = rows.unionByName(queries).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(near, f"{RESULT}, query long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")

"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing sees only how many pieces have each length, and lengths are 1 to the capacity.
So a histogram (at most ``capacity`` rows, counted in parallel) goes to the driver; best-fit
decreasing over counts, with a segment tree over remaining capacities, gives runs such as "pieces
1000 to 1999 of length 300 go one each to bins 50 to 1049, at offset 900"; and each piece finds its
run by its rank within its length, a distributed prefix sum. The result is exactly that of placing
the pieces one by one.

Defined results: a null or empty text is its end token alone; repeated rows are packed as often as
they come; rows with equal length and id are ranked in any order, which moves only equal pieces; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm import tokens
from lumenrank.llm.common import materialise, power_of_two

MOST_RUNS = 1 << 18  # rows of 48 bytes that are broadcast at most
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities: how many open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = self.size + remaining
        while i:
            self.sums[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least ``need`` that an open bin has."""
        i = self.size + need
        if self.sums[i]:
            return need
        while i > 1:
            if not i & 1 and self.sums[i + 1]:  # the next subtree to the right
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset) for counts of pieces by length.

    Piece ``first rank + j`` of a run goes to bin ``first bin + j // a bin`` at ``offset + j % a bin * length``.
    """
    tree, bins, next_bin, runs = CapacityTree(capacity), {}, 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            remaining = tree.tightest(length)
            if remaining is None:
                each = capacity // length
                first, n, remaining = next_bin, -(-(count - rank) // each), capacity
                next_bin += n
            else:
                first, n = bins[remaining].pop()
                tree.add(remaining, -n)
                each = remaining // length
            left, at = count - rank, capacity - remaining
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, at))
                put(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                runs.append((length, rank, left, first + full, left, at))
                put(remaining - left * length, first + full, 1)
                rank, full = rank + left, full + 1
            put(remaining, first + full, n - full)
    return runs


def token_pieces(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Tokenise every whole text and cut only what is longer than ``capacity``: one row per piece."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            doc_ids = batch.column(0)
            for row, ids, cuts in encoder.encode_batch(batch.column(1), end_id):
                raw = ids.astype("<u4").tobytes()
                n = np.diff(cuts)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                a = (cuts[doc] + start) * 4
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), (a + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add sequence_id and offset. ``pieces`` is read several times, so it should be a written table."""
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    runs = best_fit_decreasing([(r.length, r.n) for r in histogram], capacity)
    bits = power_of_two(sum(r.n for r in histogram), rows_per_bucket)
    spark = pieces.sparkSession
    placed = spark.createDataFrame(runs, "_length long, _rank long, _n long, _bin long, _each long, _offset long")
    if len(runs) <= MOST_RUNS:  # about as many as there are lengths, whatever the number of pieces
        placed = F.broadcast(placed)
    bucket = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 64 - bits) if bits else F.lit(0).cast("long")
    p = pieces.withColumn("_bucket", bucket)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy("_bucket", "length").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    local = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    p = p.join(counts, ["_bucket", "length"]).withColumn("_at", F.col("_before") + local)
    p = p.join(placed, (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_n")))
    j = F.col("_at") - F.col("_rank")
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return p.select(*columns, (F.col("_bin") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + j % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = materialise(token_pieces(docs, vocabulary=vocabulary, end_id=end_id, capacity=capacity), "pack-pieces")
    return pack_pieces(pieces, capacity=capacity)

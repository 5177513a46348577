"""Token ids in files of independently decodable, interleaved rANS blocks.

A file holds a run of whole documents in ascending id order. Its header has one static frequency
table shared by all its blocks, the documents' ids and lengths, and a checkpoint for each block
(byte offset, first token, counts, checksum). A block interleaves ``LANES`` coder states, so lanes
of all blocks are coded side by side in NumPy; any block decodes alone from its checkpoint.

Defined results: a null or empty text is its end token alone; a null doc_id sorts first and is kept
as null; repeated ids follow each other in any order; an empty table gives no file and no rows;
other columns are ignored. A task writes a file under a temporary name and renames it, so a second
attempt replaces what a lost executor left.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm import tokens
from lumenrank.llm.common import materialise, scratch_folder

MAGIC, LANES, BLOCK = b"LRNS0001", 64, 1 << 16
_LOW, _U = np.uint64(1 << 31), np.uint64
_CHECKPOINT = np.dtype([("offset", "<u8"), ("first", "<u8"), ("tokens", "<u4"), ("words", "<u4"), ("crc32", "<u4")])
MANIFEST = "file string, part int, seq int, n_docs long, n_tokens long, n_bytes long"


def frequency_table(counts: np.ndarray, scale_bits: int) -> np.ndarray:
    """Counts of the symbols that occur (all above 0) to frequencies of at least 1 that sum to 2**scale_bits."""
    total = 1 << scale_bits
    f = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    gap = total - int(f.sum())
    if gap >= 0:
        f[order[0]] += gap
    for i in order if gap < 0 else ():  # too many rare symbols were lifted to 1: take it from the frequent ones
        step = min(-gap, int(f[i]) - 1)
        f[i] -= step
        gap += step
        if not gap:
            break
    return f


def _encode_blocks(symbols: np.ndarray, f: np.ndarray, cum: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lane states, words) of each block of ``symbols`` [blocks, steps, lanes]; a symbol is a row of the table."""
    blocks, steps, lanes = symbols.shape
    x = np.full((blocks, lanes), _LOW, _U)
    out = np.zeros((blocks, steps, lanes), np.uint32)
    sent = np.zeros((blocks, steps, lanes), bool)
    fu, cu, shift, word = f.astype(_U), cum.astype(_U), _U(bits), _U(32)
    limit = _U(1 << (63 - bits))
    for k in range(steps - 1, -1, -1):
        s = symbols[:, k]
        fs = fu[s]
        over = x >= limit * fs
        sent[:, k] = over
        out[:, k] = x & _U(0xFFFFFFFF)
        x = np.where(over, x >> word, x)
        q = x // fs
        x = (q << shift) + (x - q * fs) + cu[s]
    return [(x[b], out[b][sent[b]]) for b in range(blocks)]


def _decode_blocks(states: np.ndarray, words: list[np.ndarray], steps: int, slot: np.ndarray, f: np.ndarray, cum: np.ndarray, bits: int) -> np.ndarray:
    blocks, lanes = states.shape
    base = np.cumsum([0, *map(len, words)])
    flat = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(_U)
    at, x = base[:-1].astype(np.int64), states.copy()
    out = np.empty((blocks, steps, lanes), slot.dtype)
    fu, cu, mask, shift = f.astype(_U), cum.astype(_U), _U((1 << bits) - 1), _U(bits)
    for k in range(steps):
        low = x & mask
        s = slot[low]
        out[:, k] = s
        x = fu[s] * (x >> shift) + low - cu[s]
        need = x < _LOW
        order = np.cumsum(need, axis=1)
        where = np.minimum(at[:, None] + order - 1, len(flat) - 1)
        x = np.where(need, (x << _U(32)) | flat[np.maximum(where, 0)], x)
        at += order[:, -1]
    return out


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of documents whose ids stand in ``ids`` one after another."""
    present, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(12, min(22, int(len(present) * 8).bit_length()))
    f = frequency_table(counts, bits)
    cum = np.cumsum(f) - f
    common = int(np.argmax(f))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    n_full = len(ids) // BLOCK
    for a in range(0, n_full, 64):
        b = min(n_full, a + 64)
        parts += _encode_blocks(inverse[a * BLOCK : b * BLOCK].reshape(b - a, BLOCK // LANES, LANES), f, cum, bits)
    if len(ids) % BLOCK:
        rest = inverse[n_full * BLOCK :]
        padded = np.full(-(-len(rest) // LANES) * LANES, common, inverse.dtype)
        padded[: len(rest)] = rest
        parts += _encode_blocks(padded.reshape(1, -1, LANES), f, cum, bits)
    body = [x.astype("<u8").tobytes() + w.astype("<u4").tobytes() for x, w in parts]
    points = np.zeros(len(parts), _CHECKPOINT)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    values = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<8sIIIQI", MAGIC, bits, LANES, len(present), len(doc_ids), len(parts))
    table = present.astype("<u4").tobytes() + f.astype("<u4").tobytes() + known.tobytes() + values.tobytes() + np.asarray(lengths).astype("<u8").tobytes()
    offset = len(head) + len(table) + points.nbytes + 4
    for k, (raw, (_, w)) in enumerate(zip(body, parts)):
        points[k] = (offset, k * BLOCK, min(BLOCK, len(ids) - k * BLOCK), len(w), zlib.crc32(raw))
        offset += len(raw)
    front = head + table + points.tobytes()
    return b"".join([front, struct.pack("<I", zlib.crc32(front)), *body])


class TokenFile:
    """A parsed file: its documents and blocks. ``blocks(a, b)`` decodes a range of blocks alone."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.lanes, n_symbols, n_docs, n_blocks = struct.unpack_from("<8sIIIQI", raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<8sIIIQI")

        def take(kind: str | np.dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.symbols, self.f = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.int64)
        self.known, self.doc_ids, self.lengths = take("u1", n_docs).astype(bool), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64)
        self.points = take(_CHECKPOINT, n_blocks)
        if zlib.crc32(raw[:at]) != struct.unpack_from("<I", raw, at)[0]:
            raise ValueError("the header's checksum is wrong")
        self.raw, self.cum = raw, np.cumsum(self.f) - self.f
        self.slot = np.repeat(np.arange(n_symbols, dtype=np.uint32), self.f)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Token ids of blocks a to b-1, checked against their checksums."""
        out = []
        while a < b:
            steps = -(-int(self.points[a]["tokens"]) // self.lanes)
            n = 1
            while a + n < b and n < 64 and -(-int(self.points[a + n]["tokens"]) // self.lanes) == steps:
                n += 1
            states, words = [], []
            for p in self.points[a : a + n]:
                size = self.lanes * 8 + int(p["words"]) * 4
                body = self.raw[int(p["offset"]) : int(p["offset"]) + size]
                if zlib.crc32(body) != p["crc32"]:
                    raise ValueError(f"block {a}: the checksum is wrong")
                states.append(np.frombuffer(body, "<u8", self.lanes))
                words.append(np.frombuffer(body, "<u4", int(p["words"]), self.lanes * 8))
            got = _decode_blocks(np.array(states).astype(_U), words, steps, self.slot, self.f, self.cum, self.bits).reshape(n, -1)
            out += [self.symbols[row[: int(p["tokens"])]] for row, p in zip(got, self.points[a : a + n])]
            a += n
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens before it in the file, ids), decoding 64 blocks at a time."""
        held, held_at, block, begin = np.zeros(0, np.uint32), 0, 0, 0
        for known, doc_id, n in zip(self.known.tolist(), self.doc_ids.tolist(), self.lengths.tolist()):
            pieces, need = [], n
            while need:
                if held_at == len(held):
                    held, held_at = self.blocks(block, min(block + 64, len(self.points))), 0
                    block += 64
                got = held[held_at : held_at + need]
                held_at += len(got)
                need -= len(got)
                pieces.append(got)
            yield (doc_id if known else None), begin, (pieces[0] if len(pieces) == 1 else np.concatenate([held[:0], *pieces]))
            begin += n


def write_token_files(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end_id: int = 2, tokens_per_file: int = 6_000_000) -> DataFrame:
    """Encode every whole text of ``docs`` into files under ``folder``, in ascending doc_id order.

    Returns the manifest, a written table with a row per file: its place in the order, documents, tokens, bytes.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        seq = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, count
            n = np.concatenate(lengths)
            raw = encode_file(np.concatenate(held), doc_ids, n)
            name = f"part-{part:06d}-{seq:04d}.rans"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(temporary := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(raw)
            fs.move(temporary, f"{root}/{name}")
            row = [[f"{folder}/{name}"], [part], [seq], [len(doc_ids)], [int(n.sum())], [len(raw)]]
            held.clear(), doc_ids.clear(), lengths.clear()
            seq, count = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["file", "part", "seq", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, ids, cuts in encoder.encode_batch(batch.column(1), end_id):
                held.append(ids)
                lengths.append(np.diff(cuts))
                doc_ids += names[row : row + len(cuts) - 1]
                count += len(ids)
                if count >= tokens_per_file:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian uint32, binary), n_tokens, ids_crc32 of each document in the files."""
    # tokens before each file: of the parts before its own, a row per part, and of its part's files before it
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.join(parts, "part").select("file", (F.col("before") + F.coalesce(inside, F.lit(0))).cast("long").alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_stream(path) as f:
                    parsed = TokenFile(f.read())
                rows: list[tuple] = []
                size = 0

                def out() -> pa.RecordBatch:
                    columns = list(zip(*rows))
                    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["doc_id", "start", "ids", "n_tokens", "ids_crc32"])

                for doc_id, begin, ids in parsed.documents():
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, first + begin, raw, len(ids), zlib.crc32(raw)))
                    size += len(raw)
                    if size > 16 << 20:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()

    tasks = min(manifest.count(), 16 * spark.sparkContext.defaultParallelism)  # beyond that a task reads several files
    return files.repartition(max(1, tasks)).mapInArrow(read, "doc_id long, start long, ids binary, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files, deleted when the interpreter ends."""
    path = scratch_folder(spark, "token-files")
    return path if "://" in path or path.startswith("/") else path.replace("file:", "")

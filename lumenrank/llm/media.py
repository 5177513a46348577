"""Audio payloads and their log-mel features.

``encode_wave`` stores bytes losslessly as the 8-bit samples of a RIFF WAVE file, ``decode_wave``
reads them back. ``audio_features`` resamples by a polyphase filter (only the taps that meet real
samples are computed), takes overlapped log-mel filterbanks, cuts all frames into patches of one fixed
shape with their time spans, and marks segments by a hysteresis on the frame energy, with their own
patches.

``write_features`` stores patches and segments as Arrow IPC files in which every tensor has Arrow's
fixed-shape type, beside its time span; ``read_features`` reads them back.

Defined results: a null payload counts as empty, and empty audio has no frame and no segment; equal
payloads give equal rows; samples are processed in blocks, so memory is bounded by a payload and its
features; columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import materialise

RATE_IN, RATE_OUT = 12_000, 8_000
UP, DOWN, TAPS = 2, 3, 24  # RATE_OUT / RATE_IN, and filter taps a phase
FRAME, HOP, MELS, PATCH = 256, 128, 16, 16
#: Frame energy in dB over the payload's own median: a segment begins above the first, ends below the second.
ON_DB, OFF_DB = 1.5, 0.5
PATCHES = "array<struct<start_ms: double, end_ms: double, mean_db: float, tensor: array<float>>>"


def encode_wave(payload: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM RIFF WAVE whose samples are the payload's bytes."""
    n, pad = len(payload), len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * pad


def decode_wave(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a mono 8-bit PCM WAVE; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """A windowed-sinc low-pass at the lower of both Nyquist rates, split by output phase: [UP, TAPS]."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T.astype(np.float32)[:, ::-1].copy()


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` (float32) at UP/DOWN times its rate; ceil(len * UP / DOWN) samples."""
    n = -(-len(x) * UP // DOWN)
    if not n:
        return np.zeros(0, np.float32)
    h, half = _phases(), TAPS // 2
    padded = np.concatenate([np.zeros(TAPS - 1 - half + 1, np.float32), x, np.zeros(half + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for k in range(UP):  # outputs k, k+UP, ... share a phase and step DOWN inputs
        first, phase = k * DOWN // UP, k * DOWN % UP
        m = len(range(k, n, UP))
        if m:
            out[k::UP] = windows[first::DOWN][:m] @ h[phase]
    return out


@cache
def _mel() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale: [FRAME/2+1, MELS]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50.0), mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE_OUT)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel in dB [frames, MELS], frame energy in dB) of overlapped Hann frames; the last is zero-padded."""
    n = max(0, 1 + -(-(len(y) - FRAME) // HOP)) if len(y) > FRAME else int(len(y) > 0)
    if not n:
        return np.zeros((0, MELS), np.float32), np.zeros(0, np.float32)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, mel, energy = np.hanning(FRAME + 1)[:-1].astype(np.float32), np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, block):
        spectrum = np.fft.rfft(frames[a : a + block] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[a : a + block] = power @ _mel()
        energy[a : a + block] = power.sum(axis=1)
    to_db = lambda v: np.round(10 * np.log10(np.maximum(v, 1e-6)), 2)
    return to_db(mel), to_db(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that begin above the upper threshold and last until below the lower one."""
    if not len(energy):
        return []
    middle = np.median(energy)
    state = np.zeros(len(energy), np.int8)
    state[energy >= middle + ON_DB] = 1
    state[energy < middle + OFF_DB] = -1
    at = np.where(state != 0, np.arange(len(energy)), -1)
    np.maximum.accumulate(at, out=at)  # frames between the thresholds keep the last state
    on = np.concatenate([[0], ((at >= 0) & (state[np.maximum(at, 0)] == 1)).astype(np.int8), [0]])
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def cut(mel: np.ndarray, energy: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[float, float, float, np.ndarray]]:
    """The frames of ``spans`` as patches: (start ms, end ms, mean dB, tensor [PATCH, MELS], filled up with -60)."""
    patches, ms = [], 1000 / RATE_OUT
    for a, b in spans:
        for i in range(a, b, PATCH):
            j = min(b, i + PATCH)
            tensor = np.full((PATCH, MELS), -60, np.float32)
            tensor[: j - i] = mel[i:j]
            patches.append((i * HOP * ms, ((j - 1) * HOP + FRAME) * ms, float(np.round(energy[i:j].mean(dtype=np.float64), 2)), tensor))
    return patches


def analysis(samples: bytes) -> tuple[int, list, list]:
    """(frames, patches of all frames, patches of the segments) of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    return len(energy), cut(mel, energy, [(0, len(energy))]), cut(mel, energy, segments(energy))


def features(samples: bytes) -> tuple[int, list[tuple[float, float, float, np.ndarray]]]:
    """(frames, patches of the segments) of 8-bit samples."""
    frames, _, patches = analysis(samples)
    return frames, patches


def fixed_shape_tensors(values: pa.Array) -> pa.FixedShapeTensorArray:
    """Flat or list-typed patch values, as they travel through Spark, as Arrow fixed-shape tensors."""
    flat = values.flatten() if not pa.types.is_floating(values.type) else values
    kind = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))


def media_table(docs: DataFrame, *, unit: int = 576) -> DataFrame:
    """doc_id, n_bytes and the WAVE of each whole text, as UTF-8 padded by bytes 255 to a multiple of ``unit``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            first, size, sizes, media = 0, 0, [], []
            for k, raw in enumerate(texts):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                sizes.append(len(raw))
                media.append(encode_wave(raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))))
                size += len(media[-1])
                if size > 16 << 20 or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([doc_ids[first : k + 1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    first, size, sizes, media = k + 1, 0, [], []

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """Read each stored WAVE back: its samples (``payload``), number of frames, patches of all frames, and segments' patches.

    ``patches`` and ``segments`` hold spans and tensors of one shape, [PATCH, MELS] flattened;
    ``fixed_shape_tensors`` gives them their Arrow type.
    """
    added = ("payload", "n_frames", "patches", "segments")

    def lists_of(found: list[list]) -> pa.Array:
        flat = [p for patches in found for p in patches]
        tensors = fixed_shape_tensors(pa.array(np.concatenate([p[3].ravel() for p in flat]) if flat else np.zeros(0, np.float32)))
        values = tensors.storage.flatten()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * PATCH * MELS, pa.int32()), values)
        structs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.float64()), pa.array([p[1] for p in flat], pa.float64()), pa.array([p[2] for p in flat], pa.float32()), lists], ["start_ms", "end_ms", "mean_db", "tensor"])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, at = batch.schema.names, batch.num_rows, batch.schema.names.index("media")
            first, size, payloads, frames, whole, found = 0, 0, [], [], [], []
            for k in range(n):
                value = batch.column(at)[k]
                payload = decode_wave(value.as_buffer().to_pybytes())[1] if value.is_valid else b""
                count, patches, marked = analysis(payload)
                payloads.append(payload)
                frames.append(count)
                whole.append(patches)
                found.append(marked)
                size += len(payload)
                if size > 8 << 20 or k == n - 1:
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(frames, pa.int64()), lists_of(whole), lists_of(found)], [*names, *added])
                    first, size, payloads, frames, whole, found = k + 1, 0, [], [], [], []

    kept = [c for c in media.columns if c not in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*kept).schema)
    return media.select(*kept).mapInArrow(compute, f"{schema}, payload binary, n_frames long, patches {PATCHES}, segments {PATCHES}")


_TENSORS = ("patches", "segments")


def _lists_with(lists: pa.ListArray, tensor_of) -> pa.ListArray:
    """``lists`` of patches with their tensors in another form."""
    flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fields = {f: pc.struct_field(flat, f) for f in ("start_ms", "end_ms", "mean_db", "tensor")}
    fields["tensor"] = tensor_of(fields["tensor"])
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _flat_tensors(tensors: pa.FixedShapeTensorArray) -> pa.ListArray:
    if tensors.type != pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS]):
        raise ValueError(f"tensors of {tensors.type}")
    values = tensors.storage.flatten()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tensors) + 1) * PATCH * MELS, pa.int32()), values)


def write_features(features: DataFrame, folder: str) -> DataFrame:
    """Store ``features`` with its columns ``patches`` and ``segments`` in Arrow IPC files under ``folder``; a file for each task.

    Returns the manifest (file, n_rows), a written table. A file is named anew by each attempt of a task, and the
    manifest lists those of the attempts that counted.
    """
    names = features.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n = None, 0
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            columns = [_lists_with(c, fixed_shape_tensors) if f in _TENSORS else c for f, c in zip(names, batch.columns)]
            out = pa.RecordBatch.from_arrays(columns, names)
            if writer is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = pa.ipc.new_file(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(out)
            n += out.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["file", "n_rows"])

    return materialise(features.mapInArrow(write, "file string, n_rows long"), "feature-manifest")


def read_features(spark: SparkSession, manifest: DataFrame, schema: T.StructType) -> DataFrame:
    """The stored rows, with tensors as flat arrays, as Spark has no type for them."""
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as source:
                    stored = pa.ipc.open_file(source)
                    for k in range(stored.num_record_batches):
                        rows = stored.get_batch(k)
                        columns = [_lists_with(c, _flat_tensors) if f in _TENSORS else c for f, c in zip(rows.schema.names, rows.columns)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    tasks = min(manifest.count(), 16 * spark.sparkContext.defaultParallelism)
    return manifest.select("file").repartition(max(1, tasks)).mapInArrow(read, schema)

"""Line deduplication by content-defined chunks of lines, and of repeated passages on any lines.

A rolling hash over the last ``window`` line hashes ends a chunk where it meets a mask, so an inserted
line moves no boundary beyond its own neighbourhood. Multi-line chunks that occur more than once in
the corpus stay at their first place (smallest doc_id, then row and position) and go everywhere else,
once their bytes were found equal to that first one's. Such chunks cannot hold a passage on one line or
a few, among lines of the document's own: every run of ``words`` words that stands earlier in the
corpus goes too. Both are found on the texts as given, in the same two readings of them, and cut at
once; what goes always has an earlier copy, and the earliest of all stays.

The first reading counts hashes of whole texts, chunks and runs' least shingles. Bitmaps of fixed size
tell the second which of them occur again, so only what may be repeated is shuffled, and which of the
texts and chunks are surely not the first of theirs: those lose their words as wholes, and the runs
inside them are not looked at one by one. Runs side by side with one least shingle travel as one row and
meet in the order of their places, ``FEW`` rows of a shingle at most. Runs of more frequent shingles are
rows each, dealt by key and salt, and what comes first under its salt meets once more by key alone. Of
texts and chunks the first is combined before the shuffle, and keys with more than a thousandth of all
their rows (fewer than a thousand keys) are dealt by salt.

Defined results: a null text stays null and an empty one empty; a text that loses all its lines
becomes empty, and its row stays; chunks of one line, of white space only, or of fewer than
``min_words`` words are never removed; rows are told apart by 128 bits of all their columns, and rows
equal in all of them count as one row, so none loses anything to the other; an empty table gives an
empty result; other columns pass through, whatever their names, and columns with the names of the
added ones are replaced.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lumenrank.llm import wordhash
from lumenrank.llm.common import materialise, release, row_digest

WINDOW, MASK, MOST = 2, 3, 16  # lines of the rolling hash; one boundary in MASK + 1; lines of a chunk at most
PASSAGE, BITS = 51, 26  # words of a passage at least; log2 of the bitmap of shingles that occur again
CHUNK, RUN, TEXT = 0, 1, 2  # kinds of what is looked for: chunks of lines, runs of words, whole texts
FIRST, HOT, FEW = 10, 20, 4096  # added to a kind: places that may be the first, what occurs more than FEW times
PACKED = RUN + 10  # the kind of a row of runs side by side: h1 their least shingle, body their digests
FOUND = "kind int, r1 long, r2 long, doc_id long, at int, h1 long, h2 long, body binary"
SALTS, WHOLE = 64, -(1 << 31)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line (the newline left out), and per text the index of its first line."""
    ends = np.flatnonzero(data == 0x0A)
    per_text = np.searchsorted(ends, offsets[1:]) - np.searchsorted(ends, offsets[:-1]) + 1
    firsts = np.concatenate([[0], np.cumsum(per_text)])
    stop = np.empty(firsts[-1], np.int64)
    last = np.zeros(len(stop), bool)
    last[firsts[1:] - 1] = True
    stop[last], stop[~last] = offsets[1:], ends
    start = np.empty(len(stop), np.int64)
    start[1:] = stop[:-1] + 1
    start[firsts[:-1]] = offsets[:-1]
    return start, stop, firsts


def chunk_ends(line_hashes: np.ndarray) -> list[int]:
    """Ends (exclusive line numbers) of one text's chunks."""
    n = len(line_hashes)
    rolling = line_hashes.copy()
    for k in range(1, min(WINDOW, n)):
        rolling[k:] += line_hashes[:-k] * np.uint64(2 * k + 1)
    stops = (np.flatnonzero((wordhash.mix(rolling) & np.uint64(MASK)) == 0) + 1).tolist()
    ends, at = [], 0
    for s in [*stops, n]:
        while s - at > MOST:
            at += MOST
            ends.append(at)
        if s > at and (s - at >= 2 or s == n):  # no boundary inside the first two lines of a chunk
            at = s
            ends.append(at)
    return ends


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """(text, chunk, first line, lines, start byte, end byte) arrays of a run of texts."""
    start, stop, firsts = line_spans(data, offsets)
    h = wordhash.hashes(data, start, stop) if len(data) else np.zeros(len(start), np.uint64)
    doc, number, a, b = [], [], [], []
    for d, (i, j) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        at = 0
        for k, e in enumerate(chunk_ends(h[i:j])):
            doc.append(d)
            number.append(k)
            a.append(i + at)
            b.append(i + e)
            at = e
    doc, number, a, b = (np.array(x, np.int64) for x in (doc, number, a, b))
    return doc, number, a - firsts[doc], b - a, start[a], stop[b - 1]


def sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def passage_windows(data: np.ndarray, offsets: np.ndarray, words: int):
    """Word starts, ends, texts' first words; and per run of ``words`` words inside one text (others 0) its least shingle hash, with all shingle hashes."""
    starts, ends, firsts = wordhash.spans(data, offsets, wordhash.ASCII_SPACE)
    shingle = (words + 1) // 2
    if len(starts) < words:
        return starts, ends, firsts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    h = np.maximum(wordhash.windows(wordhash.hashes(data, starts, ends), shingle), np.uint64(1))
    least = sliding(np.minimum, h, words - shingle + 1)
    return starts, ends, firsts, np.where(text[: len(least)] == text[words - 1 :], least, np.uint64(0)), h


def large_chunks(data: np.ndarray, offsets: np.ndarray, min_words: int):
    """Text, number, start and end byte, and hash of the chunks of two lines and ``min_words`` words at least."""
    doc, number, _, lines, start, stop = _chunks(data, offsets)
    ws, _, _ = wordhash.spans(data, offsets, wordhash.ASCII_SPACE)
    keep = np.flatnonzero((lines >= 2) & (np.searchsorted(ws, stop) - np.searchsorted(ws, start) >= min_words))
    h = wordhash.hashes(data, start[keep], stop[keep]) if len(keep) else np.zeros(0, np.uint64)
    return doc[keep], number[keep], start[keep], stop[keep], h


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """128 bits of each span, as two columns; nobody who writes a text knows the seed."""
    joined = b"".join([xxh3_128_digest(raw[i:j], seed) for i, j in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _places(h: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    return wordhash.mix(h ^ wordhash.mix(doc_ids.view(np.uint64)))


def _again(rows: DataFrame, min_words: int | None, words: int | None, few: int) -> dict[int, np.ndarray]:
    """Bitmaps of 8 MB each: which ranges of hash space hold something that occurs again, its first place, or a frequent shingle."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in wordhash.blocks(batch.column(1)):
                full = np.flatnonzero(np.diff(offsets) > 0)
                found = [(TEXT, wordhash.hashes(data, offsets[full], offsets[full + 1]), full)]
                if min_words is not None:
                    doc, _, _, _, h = large_chunks(data, offsets, min_words)
                    found.append((CHUNK, h, doc))
                if words is not None:
                    *_, least, h = passage_windows(data, offsets, words)
                    if len(h):
                        pad = np.zeros(len(h) - len(least), np.uint64)
                        found.append((RUN, h[sliding(np.maximum, np.concatenate([pad, least, pad]), len(pad) + 1) == h], None))
                for kind, h, doc in found:
                    place = pa.array(doc_ids[row + doc]) if doc is not None else pa.nulls(len(h), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), place], ["kind", "h", "doc_id"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            doc_id, h = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), h.view(np.uint64)
            first, hot = np.flatnonzero(kind != RUN), np.flatnonzero((kind == RUN) & (n > few))
            bit = np.concatenate([h, _places(h[first], doc_id[first]), h[hot]]) >> np.uint64(64 - BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kind, kind[first] + np.int32(FIRST), kind[hot] + np.int32(HOT)])), pa.array(bit.astype(np.int64))], ["kind", "bit"])

    key = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))), "text")
    again = key.mapInArrow(signatures, "kind int, h long, doc_id long").groupBy("kind", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1")
    bit = F.col("bit") + 1
    set_ = again.select("kind", "h", "doc_id", "n").mapInArrow(bits, "kind int, bit long")
    parts = set_.groupBy("kind", F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = {k: np.zeros((1 << BITS) // 8, np.uint8) for k in (CHUNK, RUN, TEXT, CHUNK + FIRST, TEXT + FIRST, RUN + HOT)}
    for p in parts:
        out[p.kind][(p.k - 1) * 4096 :][: len(p.bits)] = np.frombuffer(p.bits, np.uint8)
    return out


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _occurrences(rows: DataFrame, min_words: int | None, words: int | None, few: int) -> DataFrame:
    """Every text, chunk and run that may be repeated: its row and place, a digest, and a chunk's bytes; runs of one shingle packed."""
    bitmaps = {k: zstandard.ZstdCompressor(level=1).compress(v.tobytes()) for k, v in _again(rows, min_words, words, few).items()}
    sent, seed = rows.sparkSession.sparkContext.broadcast(bitmaps), secrets.randbits(64)
    names = ["kind", "r1", "r2", "doc_id", "at", "h1", "h2", "body"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.frombuffer(zstandard.ZstdDecompressor().decompress(v), np.uint8) for k, v in sent.value.items()}
        for batch in batches:
            doc_ids = batch.column(2).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)

            def rows_of(kind: int, row: np.ndarray, at: np.ndarray, digest: np.ndarray, body: pa.Array | None = None) -> pa.RecordBatch:
                columns = [batch.column(k).take(pa.array(row)) for k in range(3)]
                last = body if body is not None else pa.nulls(len(row), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), *columns, pa.array(at.astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), last], names)

            def later(kind: int, h: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
                """Which repeated ones are surely not the first of theirs."""
                return _is_set(known[kind], h) & ~_is_set(known[kind + FIRST], _places(h, doc_id))

            for row, data, offsets in wordhash.blocks(batch.column(3)):
                raw, ids = data.tobytes(), doc_ids[row : row + len(offsets) - 1]
                whole = wordhash.hashes(data, offsets[:-1], offsets[1:])
                copies = np.flatnonzero(_is_set(known[TEXT], whole) & (np.diff(offsets) > 0))
                if len(copies):
                    yield rows_of(TEXT, copies + row, np.zeros(len(copies)), _digests(raw, offsets[copies], offsets[copies + 1], seed))
                gone = later(TEXT, whole, ids)
                covered = np.zeros(len(data) + 1, np.int8)
                if min_words is not None:
                    doc, number, start, stop, h = large_chunks(data, offsets, min_words)
                    moot = later(CHUNK, h, ids[doc])
                    covered[start[moot]] += 1
                    covered[stop[moot]] -= 1
                    at = np.flatnonzero(_is_set(known[CHUNK], h) & ~gone[doc])
                    if len(at):
                        start, stop = start[at], stop[at]
                        yield rows_of(CHUNK, doc[at] + row, number[at], _digests(raw, start, stop, seed), pa.array([raw[i:j] for i, j in zip(start.tolist(), stop.tolist())], pa.binary()))
                if words is not None:
                    starts, ends, firsts, least, _ = passage_windows(data, offsets, words)
                    open_ = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1], dtype=np.int8)[starts] == 0)])  # words that no later chunk covers
                    found = np.flatnonzero((least > 0) & _is_set(known[RUN], least) & (open_[words:] > open_[:-words])[: len(least)]) if len(least) else []
                    if len(found):
                        doc = np.searchsorted(firsts, found, side="right") - 1
                        found, doc = found[~gone[doc]], doc[~gone[doc]]
                    for k in range(0, len(found), 1 << 16):
                        at, of = found[k : k + (1 << 16)], doc[k : k + (1 << 16)]
                        digest, place, key = _digests(raw, starts[at], ends[at + words - 1], seed), at - firsts[of], least[at]
                        hot = _is_set(known[RUN + HOT], key)
                        if hot.any():
                            yield rows_of(RUN, of[hot] + row, place[hot], digest[hot])
                        at, of, digest, place, key = (x[~hot] for x in (at, of, digest, place, key))
                        if len(at):
                            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0) | (key[1:] != key[:-1])]))
                            ends_ = np.concatenate([cut, [len(at)]]).astype(np.int32) * np.int32(16)
                            packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends_), pa.py_buffer(np.ascontiguousarray(digest))])
                            yield rows_of(PACKED, of[cut] + row, place[cut], np.stack([key[cut].view(np.int64), np.zeros(len(cut), np.int64)], axis=1), packed)

    return rows.mapInArrow(compute, FOUND)


def later_runs(packed: DataFrame, words: int) -> DataFrame:
    """r1, r2, gone of rows (h1, doc_id, r1, r2, at, body) of runs side by side that come later than an equal run."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
            """All rows of some shingles, in the order of their places."""
            r1, r2, at = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            sizes = pa.compute.binary_length(rows.column(5)).to_numpy(zero_copy_only=False) // 16
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            digest = wordhash.buffers(rows.column(5))[0].view("<i8").reshape(-1, 2)
            order = np.lexsort((digest[:, 1], digest[:, 0]))  # stable: equal digests stay in the order of their places
            new = np.ones(len(order), bool)
            new[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
            first = np.empty(len(order), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            other = (r1[row] != r1[row[first]]) | (r2[row] != r2[row[first]])
            gone = np.flatnonzero(other | (start >= start[first] + words))
            has = np.unique(row[gone])
            cuts = np.searchsorted(row[gone], np.append(has, len(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(start[gone].astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(r1[has]), pa.array(r2[has]), lists], ["r1", "r2", "gone"])

        held = None  # the rows of the last shingle so far
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if rows.num_rows:
                h = rows.column(0).to_numpy(zero_copy_only=False)
                cut = int(np.argmax(h == h[-1]))
                held = rows.slice(cut)
                if cut:
                    yield settle(rows.slice(0, cut))
        if held is not None:
            yield settle(held)

    rows = packed.select("h1", F.col("doc_id"), "r1", "r2", "at", "body").repartition("h1")
    return rows.sortWithinPartitions("h1", F.col("doc_id").asc_nulls_first(), "r1", "r2", "at").mapInArrow(compute, "r1 long, r2 long, gone array<int>")


def later_frequent_runs(runs: DataFrame, words: int) -> DataFrame:
    """r1, r2, gone (one word) of the runs that come later than an equal one; a key's rows may be a third of all."""
    place = F.struct("r1", "r2", "at")

    def first(*keys: str) -> Column:
        return F.first(place).over(Window.partitionBy("h1", "h2", *keys).orderBy(F.col("doc_id").asc_nulls_first(), "r1", "r2", "at"))

    later = (F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2")) | (F.col("at") >= F.col("first.at") + words)
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("r1", "r2"), F.lit(SALTS)))
    once = salted.withColumn("first", first("salt")).select("h1", "h2", "doc_id", "r1", "r2", "at", later.alias("gone"))
    once = materialise(once, "frequent-runs")
    # of a key and salt stay the first and what overlaps it in its own row
    again = once.filter("NOT gone").withColumn("first", first()).filter(later)
    return once.filter("gone").unionByName(again.drop("first")).select("r1", "r2", F.col("at").alias("gone"))


def later_wholes(found: DataFrame) -> DataFrame:
    """r1, r2, gone (a chunk's or text's number) of the chunks and texts that come later than an equal one."""
    keys = ["kind", "h1", "h2"]
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "r1", "r2", "at", "body")
    firsts = materialise(found.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "repeat-firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(firsts.filter(F.col("n") * 1000 > total).select(*keys, F.lit(True).alias("warm")))  # fewer than 1000 rows
    salt: Column = F.when(F.col("warm"), F.pmod(F.xxhash64("r1", "r2", "at"), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("warm"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = found.join(hot, keys, "left").withColumn("salt", salt.cast("int")).select(*keys, "salt", "r1", "r2", "at", "body")
    right = firsts.select(*keys, "first").join(hot, keys, "left").select(*keys, "first", F.explode(salts).alias("salt"))
    met = left.join(right, [*keys, "salt"]).filter((F.col("kind") == TEXT) | (F.col("body") == F.col("first.body")))
    other = (F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2"))
    gone = F.when(F.col("kind") == CHUNK, -1 - F.col("at")).otherwise(F.lit(WHOLE))
    return met.filter(other | (F.col("at") != F.col("first.at"))).select("r1", "r2", gone.alias("gone"))


def repeats(rows: DataFrame, *, min_words: int | None, words: int | None, few: int = FEW) -> DataFrame:
    """r1, r2, gone of the rows (r1, r2, doc_id, text) that lose something: chunk c as -1 - c, the run from word w on as w, the whole text as WHOLE."""
    found = materialise(_occurrences(rows, min_words, words, few), "repeat-places")
    packed = later_runs(found.filter(F.col("kind") == PACKED), words or 0)
    frequent, other = later_frequent_runs(found.filter(F.col("kind") == RUN), words or 0), later_wholes(found.filter(F.col("kind").isin(CHUNK, TEXT)))
    single = frequent.unionByName(other).select("r1", "r2", F.array("gone").alias("gone"))
    out = packed.unionByName(single).groupBy("r1", "r2").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    out = materialise(out, "repeats")
    release(found)
    return out


def cut_words(text: bytes, starts: list[int], words: int) -> tuple[bytes, int]:
    """``text`` without the runs of ``words`` words from ``starts`` on, and the number of words gone."""
    a, _, _ = wordhash.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]), wordhash.ASCII_SPACE)
    return cut_marked(text, marked(len(a), starts, words))


def marked(n: int, starts: list[int], words: int) -> np.ndarray:
    """Which of ``n`` words lie in the runs of ``words`` words from ``starts`` on."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.array(starts, np.int64), 1)
    np.add.at(step, np.array(starts, np.int64) + words, -1)
    return np.cumsum(step)[:-1] > 0


def cut_marked(text: bytes, gone: np.ndarray) -> tuple[bytes, int]:
    """``text`` without its marked words, and their number.

    Of the white space on both sides of a cut one stays: the later one if only it has a newline.
    """
    if not gone.any():
        return text, 0
    a, b, _ = wordhash.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]), wordhash.ASCII_SPACE)
    if gone.all():
        return b"", len(a)
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], 0
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        before = text[b[i - 1] : a[i]] if i else None
        after = text[b[j - 1] : a[j]] if j < len(a) else None
        later = before is None or (after is not None and b"\n" in after and b"\n" not in before)
        out.append(text[at : b[i - 1] if later and i else a[i] if i == 0 or after is not None else b[i - 1]])
        at = b[j - 1] if after is None or (later and i) else a[j]
    return b"".join([*out, text[at:]]), int(gone.sum())


def without(text: bytes, gone: list[int], min_words: int | None, words: int | None) -> tuple[bytes, int, int, int]:
    """``text`` without the chunks and runs of ``gone``; the lines, the chunks, and the words beyond them, that went."""
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, _, _ = wordhash.spans(data, offsets, wordhash.ASCII_SPACE)
    if WHOLE in gone:  # a copy of a whole text: all its chunks and runs
        chunks = set(large_chunks(data, offsets, min_words)[1].tolist()) if min_words is not None else set()
        runs = range(len(starts) - words + 1) if words is not None else ()
    else:
        chunks, runs = {-1 - x for x in gone if x < 0}, [x for x in gone if x >= 0]
    mark, lines = marked(len(starts), list(runs), words or 0), 0
    if chunks:
        _, number, _, n, start, stop = _chunks(data, offsets)
        stay = ~np.isin(number, list(chunks))
        lines = int(n[~stay].sum())
        mark = mark[stay[np.searchsorted(stop, starts, side="right")]]  # a word's chunk is the first that ends behind it
        text = b"\n".join(text[i:j] for i, j in zip(start[stay].tolist(), stop[stay].tolist()))
    text, cut = cut_marked(text, mark)
    return text, lines, len(chunks), cut


def dedup_repeats(docs: DataFrame, *, min_words: int | None = 10, words: int | None = PASSAGE) -> DataFrame:
    """``docs`` without its repeated chunks of lines (of ``min_words`` words or more) and repeated runs of ``words`` words.

    Adds n_lines, removed_lines and removed_chunks, and removed_words (those in runs beyond removed chunks).
    None for ``min_words`` or ``words`` leaves out that half and its columns. A run with its white space
    stays where it comes first (smallest doc_id, then row and position) and goes everywhere else, except
    where it overlaps that first place; runs side by side join, so a passage goes up to its true edges.
    Runs and whole texts are equal if 128-bit digests of their bytes, under a seed of the moment, are.
    """
    added = [*(("n_lines", "removed_lines", "removed_chunks") if min_words is not None else ()), *(("removed_words",) if words is not None else ())]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    r1, r2 = row_digest(docs)
    key = docs.select(F.struct("*").alias("d"), r1.alias("r1"), r2.alias("r2"))
    rows = key.select("r1", "r2", F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").alias("text"))
    joined = key.join(repeats(rows, min_words=min_words, words=words), ["r1", "r2"], "left")

    @F.arrow_udf("text string, removed_lines long, removed_chunks long, removed_words long")
    def rebuilt(texts: pa.Array, gone: pa.Array) -> pa.Array:
        counts, changed = np.zeros((3, len(texts)), np.int64), []
        at = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for k in at:
            text, *counts[:, k] = without(texts[k].as_py().encode(), gone[k].as_py(), min_words, words)
            changed.append(text.decode())
        if at:
            mask = np.zeros(len(texts), bool)
            mask[at] = True
            texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(changed, texts.type))
        return pa.StructArray.from_arrays([texts, *map(pa.array, counts)], ["text", "removed_lines", "removed_chunks", "removed_words"])

    text, changed = F.col("d.text"), F.col("gone").isNotNull()
    size = F.octet_length(text)
    n_lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + (size > 0).cast("int")
    # only the texts that lose something go through Python
    out = joined.select("d", changed.alias("changed"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), rebuilt(F.when(changed, text), "gone").alias("o"))
    kept = F.when(F.col("changed"), F.col("o.text")).otherwise(F.col("d.text"))
    return out.select(*[kept.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns], *["n_lines" if c == "n_lines" else f"o.{c}" for c in added])


def dedup_lines(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """``docs`` with its repeated multi-line chunks removed, and n_lines, removed_lines, removed_chunks added."""
    return dedup_repeats(docs, min_words=min_words, words=None)


def dedup_passages(docs: DataFrame, *, words: int = PASSAGE) -> DataFrame:
    """``docs`` without the passages of ``words`` words or more that stand earlier in the corpus, whatever their lines; removed_words added."""
    return dedup_repeats(docs, min_words=None, words=words)

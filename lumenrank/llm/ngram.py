"""Exact n-gram Jaccard join with adaptive multi-match prefixes, up to connected components.

Sets of word shingles (as 64-bit hashes) are ordered by one global order: tokens that occur once in the
corpus by their hash, then the others, the frequent ones by their exact count. With ``need = ceil(t * n)`` tokens
that any partner must share, two linked sets share at least ``l`` tokens of their first
``n - need + l`` ones. Each document takes the ``l`` with the least estimated cost: every further
prefix token is one more posting, but a candidate must then share ``l`` of them. A pair is a candidate
if it shares ``min(l, l')`` prefix tokens; candidates are verified on their whole sets.

No step emits all pairs of a group. Equal sets are one class. Classes that share a prefix token are
first joined inside blocks of bounded size (one product of incidence matrices a block); what the
blocks have joined counts as one from then on. Then blocks meet as wholes: two blocks whose classes share
enough prefix tokens, the count taken over all their members, are verified against each other. So a
group of near copies costs its blocks, and every link between different sets is still found.

Shingles are compared by 64-bit hashes and sets named by 128 bits, both of mixed lanes, so two
different ones are taken for one another only by chance.

Defined results: a null or empty text, or one of white space only, has an empty set and is linked
with nothing; fewer words than a shingle make one shingle; repeated rows and ids are rows each, and a
component's id is the smallest id in it; rows without an id belong to components but do not name
them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm import wordhash
from lumenrank.llm.common import materialise, release

BUCKET_BITS, SLICE_BITS = 30, 8  # token counts are kept per bucket of hash space, summed per slice of it
MAP_BITS = 27  # of hash space, that tell in a map of 16 MB whether a token occurs again
HEAVY, MOST_HEAVY = 8, 1 << 19  # counts from which a bucket is frequent, and how many frequent ones are sent out
DIRECT = 256  # postings of tokens this frequent need no look for a partner
MOST_MATCHES = 32  # the largest l
PAIR_COST = 20  # of a candidate pair, in postings
BLOCK_TOKENS, BLOCK_SETS = 1 << 16, 1 << 10  # about the most tokens, and sets, that are joined in one block
SMALL = 100_000  # edges that one task settles at once
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and n+1 cuts."""
    starts, ends, cuts = wordhash.spans(data, offsets, wordhash.ASCII_SPACE)
    h = wordhash.hashes(data, starts, ends, fold=True) if len(data) else np.zeros(0, _U)
    n = np.diff(cuts)
    g = np.full(len(h), words, _U)
    for k in range(words):
        if len(h) > k:
            g[: len(h) - k] = wordhash.mix(g[: len(h) - k] * _U(0x9E3779B97F4A7C15) + h[k:])
    owner = np.repeat(np.arange(len(n)), n)
    valid = np.arange(len(h)) + words <= cuts[1:][owner]
    for d in np.flatnonzero((n > 0) & (n < words)).tolist():  # the whole sequence is the one shingle
        x = np.full(1, n[d], _U)
        for k in range(cuts[d], cuts[d + 1]):
            x = wordhash.mix(x * _U(0x9E3779B97F4A7C15) + h[k : k + 1])
        g[cuts[d]], valid[cuts[d]] = x[0], True
    g, owner = g[valid], owner[valid]
    at = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], np.concatenate([[0], np.cumsum(new)])[at]


def _digests(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set; 0 for an empty one."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(wordhash.mix(values ^ _U(salt)))])
        out.append(wordhash.mix(sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


COUNTED = "doc_id long, n long, a long, b long, slice int, blob binary"


def _count_pass(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (set size and digest), and packed token counts per slice of hash space."""
    names = ["doc_id", "n", "a", "b", "slice", "blob"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            buckets, counts = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            cuts = np.searchsorted(buckets, np.arange((1 << SLICE_BITS) + 1, dtype=np.int64) << (BUCKET_BITS - SLICE_BITS))
            slices, blobs = [], []
            for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if j > i:
                    slices.append(s)
                    blobs.append(_pack(np.diff(buckets[i:j], prepend=np.uint32(0)).astype("<u4"), counts[i:j].astype("<u4")))
            none = [None] * len(slices)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((none, none, none, none, slices, blobs), types)], names)

        for batch in batches:
            for row, data, offsets in wordhash.blocks(batch.column(1)):
                values, cuts = shingle_sets(data, offsets, words)
                a, b = _digests(values, cuts)
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(cuts)), pa.array(a), pa.array(b), pa.nulls(n, types[4]), pa.nulls(n, types[5])], names)
                held.append((values >> _U(64 - BUCKET_BITS)).astype(np.uint32))
                size += len(values)
                if size > 2 << 20:
                    yield flush()
        if size:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, COUNTED)


@dataclass(frozen=True)
class TokenCounts:
    """What is sent to all tasks about the corpus's tokens; its size does not grow with the corpus.

    ``again``: a bit per range of hash space in which a token occurs more than once. ``bucket`` (ascending)
    and ``count``: the most frequent tokens. Both only order tokens, so what they leave out costs time, not results.
    """

    again: np.ndarray
    bucket: np.ndarray
    count: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        """0 for tokens that occur once, the count of frequent ones, 2 for the rest."""
        at = values >> _U(64 - MAP_BITS)
        out = np.zeros(len(values), np.int64)
        hit = np.flatnonzero(self.again[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1)
        out[hit] = 2
        if len(self.bucket):
            where = (values[hit] >> _U(64 - BUCKET_BITS)).astype(np.uint32)
            k = np.minimum(np.searchsorted(self.bucket, where), len(self.bucket) - 1)
            same = self.bucket[k] == where
            out[hit[same]] = self.count[k[same]]
        return out


def _token_counts(counted: DataFrame) -> TokenCounts:
    """Counts of the whole corpus's tokens, added up slice by slice of hash space."""
    width = BUCKET_BITS - SLICE_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, total = None, None

        def out() -> pa.RecordBatch:
            again = (total >= 2).reshape(-1, 1 << (BUCKET_BITS - MAP_BITS)).any(axis=1)
            at = np.flatnonzero(total >= HEAVY)
            row = [[slice_], [np.packbits(again, bitorder="little").tobytes()], [(at + (slice_ << width)).astype("<u4").tobytes()], [total[at].astype("<u4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "again", "bucket", "count"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != slice_:
                    if slice_ is not None:
                        yield out()
                    slice_, total = s, np.zeros(1 << width, np.uint32)
                x = np.frombuffer(_unpack(blob.as_buffer().to_pybytes()), "<u4")
                total[np.cumsum(x[: len(x) // 2].astype(np.int64)) - (s << width)] += x[len(x) // 2 :]
        if slice_ is not None:
            yield out()

    blobs = counted.filter("slice IS NOT NULL").select("slice", "blob").repartition("slice").sortWithinPartitions("slice")
    summed = materialise(blobs.mapInArrow(add, "slice int, again binary, bucket binary, count binary"), "ngram-tokens")
    again = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    piece = len(again) >> SLICE_BITS
    for r in summed.select("slice", "again").toLocalIterator():
        again[r.slice * piece : (r.slice + 1) * piece] = np.frombuffer(r["again"], np.uint8)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)) for x in (b, n)], ["bucket", "n"])

    top = summed.select("bucket", "count").mapInArrow(unpack, "bucket long, n long").orderBy(F.desc("n"), "bucket").limit(MOST_HEAVY).toArrow()
    release(summed)
    bucket, n = top["bucket"].to_numpy().astype(np.uint32), top["n"].to_numpy()
    order = np.argsort(bucket)
    return TokenCounts(again, bucket[order], n[order])


def choose_prefix(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set under the global order, and its number of matches l."""
    n = len(values)
    first = n - -(-n * percent // 100) + 1  # length for one match
    most = min(MOST_MATCHES, n - first + 1)
    light = np.flatnonzero(counts == 0)
    if len(light) >= first:
        return values[light[:first]], 1
    heavy = np.flatnonzero(counts)
    heavy = heavy[np.argsort(counts[heavy], kind="stable")]
    order = np.concatenate([light, heavy])[: first + most - 1]
    met = np.cumsum(np.maximum(counts[order] - 1, 0))  # postings that the prefix tokens meet
    matches = np.arange(1, most + 1)
    cost = (first + matches - 1) + PAIR_COST * met[first - 1 :] / matches
    k = int(np.argmin(cost))
    return values[order[: first + k]], k + 1


POSTINGS = "token long, a long, b long, n int, l int, direct boolean"


def _shared_postings(docs: DataFrame, words: int, percent: int, tokens_of: TokenCounts, slices: int) -> DataFrame:
    """The prefix postings (of classes, not documents) of tokens that two classes have.

    Postings are rows that Spark shuffles and sorts by token, so a task holds a batch of them, whatever the
    token. Those of frequent tokens have a partner for sure and are dealt by token and class.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokens_of)
    names = ["token", "a", "b", "n", "l", "direct"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, data, offsets in wordhash.blocks(batch.column(0)):
                values, cuts = shingle_sets(data, offsets, words)
                a, b = _digests(values, cuts)
                counts = known.of(values)
                tokens, of, matches = [], [], []
                for d, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    key = (int(a[d]), int(b[d]))
                    if i == j or key in seen:
                        continue
                    if len(seen) < 200_000:  # only saves postings of copies
                        seen.add(key)
                    prefix, k = choose_prefix(values[i:j], counts[i:j], percent)
                    tokens.append(prefix)
                    of.append(d)
                    matches.append(k)
                if not of:
                    continue
                lengths = [len(t) for t in tokens]
                doc, t = np.repeat(of, lengths), np.concatenate(tokens)
                columns = [t.view(np.int64), a[doc], b[doc], np.diff(cuts)[doc].astype(np.int32), np.repeat(matches, lengths).astype(np.int32), known.of(t) >= DIRECT]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of postings sorted by token and class: each once, if another class has its token or it is frequent."""
        last, sent_on = None, False  # the last row of the batch before, and whether it went on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.concat_batches([last, batch])
            t, a, b = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            same = t[at][1:] == t[at][:-1]
            keep = rows.column(5).to_numpy(zero_copy_only=False)[at].copy()
            keep[1:] |= same
            keep[:-1] |= same
            if sent_on:
                keep[0] = False
            sent_on = bool(keep[-1]) or (sent_on and len(at) == 1)
            last = rows.slice(int(at[-1]), 1)
            yield rows.take(pa.array(at[keep]))

    rows = docs.select("text").mapInArrow(emit, POSTINGS)
    deal = F.when(F.col("direct"), F.xxhash64("token", "a", "b")).otherwise(F.col("token"))
    few = slices <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # then Spark's own number, which it lowers as it sees fit
    dealt = rows.repartition(deal) if few else rows.repartition(slices, deal)
    return dealt.sortWithinPartitions("token", "a", "b").mapInArrow(met, POSTINGS).select("token", _class(), "n", "l")


def _possible(postings: DataFrame) -> DataFrame:
    """Postings of classes that share as many tokens as the least demanding class they meet asks for."""
    asked = postings.groupBy("token").agg(F.min("l").alias("asked"), F.count("*").alias("met")).filter("met > 1")
    enough = postings.join(asked, "token").groupBy("c").agg(F.count("*").alias("shared"), F.min("asked").alias("asked")).filter("shared >= asked").select("c")
    return postings.join(enough, "c", "left_semi")


def _class(a: str = "a", b: str = "b") -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("c")


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c, n, set (sorted hashes, binary) of the wanted classes, from the text of one document each."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(key.alias("k"), "text").join(wanted.select("k", F.col("c.a").alias("a"), F.col("c.b").alias("b")), "k").select("a", "b", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want_a, want_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for row, data, offsets in wordhash.blocks(batch.column(2)):
                values, cuts = shingle_sets(data, offsets, words)
                a, b = _digests(values, cuts)
                keep = np.flatnonzero((a == want_a[row : row + len(a)]) & (b == want_b[row : row + len(a)])).tolist()
                sets = [values[cuts[d] : cuts[d + 1]].tobytes() for d in keep]
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array(sets, pa.binary())], ["a", "b", "n", "set"])

    return texts.mapInArrow(compute, "a long, b long, n int, set binary").select(_class(), "n", "set")


def links(sets: list[np.ndarray], percent: int, other: list[np.ndarray] | None = None) -> np.ndarray:
    """Index pairs (i, j) of linked sets: i < j within ``sets``, or i in ``sets`` and j in ``other``."""
    right = sets if other is None else other
    if len(sets) * len(right) <= 4:
        out = []
        for i, x in enumerate(sets):
            for j, y in enumerate(right):
                if other is None and j <= i or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if both * 100 >= percent * (len(x) + len(y) - both):
                    out.append((i, j))
        return np.array(out, np.int64).reshape(-1, 2)
    everything = sets if other is None else [*sets, *other]
    sizes = np.array([len(s) for s in everything])
    tokens, at, n = np.unique(np.concatenate(everything), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(everything)), sizes)
    column = np.cumsum(n > 1) - 1  # tokens of one set alone meet nothing
    use = (n > 1)[at]
    owner, column = owner[use], column[at][use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = (slice(0, len(sets)), slice(0, len(sets))) if other is None else (slice(0, len(sets)), slice(len(sets), len(everything)))
    both = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
    total, width = (int(column[-1]) + 1 if len(column) else 0), max(256, (1 << 22) // len(everything))
    for lo in range(0, total, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(everything), min(width, total - lo)), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        both += m[a] @ m[b].T
    found = []
    for i in range(0, len(both), 256):  # in whole numbers, some rows at a time
        some = both[i : i + 256].astype(np.int64)
        hit = some * 100 >= percent * (sizes[a][i : i + 256, None] + sizes[b][None, :] - some)
        found.append(np.argwhere(hit) + [i, 0])
    pairs = np.concatenate(found)
    return pairs if other is not None else pairs[pairs[:, 0] < pairs[:, 1]]


def _lowest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return np.array([find(x) for x in range(n)], np.int64)


def _join_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(c, m) of each class of ``members`` (c, home, salt, set): the smallest class it reaches inside its block."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for group in batch.column(0):
                rows = sorted({(x["a"], x["b"]): x["set"] for x in group.as_py()}.items())
                root = _lowest(len(rows), links([np.frombuffer(s, "<u8") for _, s in rows], percent))
                for (key, _), r in zip(rows, root.tolist()):
                    for o, v in zip(out, (*key, *rows[r][0])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b", "ma", "mb"])

    blocks = members.groupBy("home", "salt").agg(F.collect_list(F.struct("c.a", "c.b", "set")).alias("g")).filter(F.size("g") > 1)
    return blocks.select("g").mapInArrow(compute, "a long, b long, ma long, mb long").select(_class(), F.struct(F.col("ma").alias("a"), F.col("mb").alias("b")).alias("m"))


def _settle(e: DataFrame) -> DataFrame:
    """(u, root) of a table of at most ``SMALL`` edges, in one task."""
    kind = e.schema["u"].dataType

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        edges = pa.Table.from_batches(table).to_pydict()
        name = (lambda x: tuple(x.values())) if isinstance(kind, T.StructType) else (lambda x: x)
        of = {name(x): x for c in ("u", "v") for x in edges[c]}
        nodes = sorted(of)
        place = {x: k for k, x in enumerate(nodes)}
        root = _lowest(len(nodes), np.array([[place[name(u)], place[name(v)]] for u, v in zip(edges["u"], edges["v"])]))
        rows = [(of[x], of[nodes[r]]) for x, r in zip(nodes, root.tolist()) if nodes[r] != x]
        type_ = table[0].schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type_) for k in (0, 1)], ["u", "root"])

    return e.coalesce(1).mapInArrow(compute, T.StructType([T.StructField("u", kind), T.StructField("root", kind)]))


def connected_components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots: alternating large and small stars, in the cluster.

    The rounds grow with the logarithm of the nodes; a graph that ``most_rounds`` do not settle is an error.
    At most ``small`` edges (counted first) are settled in one task, with the same result.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "stars")
    if e.count() <= small:
        return _settle(e)
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialise(small.filter("u != v").distinct(), "stars")
        release(e, large)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (now.n, now.s):
            break
        state = (now.n, now.s)
    else:
        raise RuntimeError(f"connected components did not settle in {most_rounds} rounds")
    return e.select("u", F.col("v").alias("root"))


def _merge(postings: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((c, m): classes joined inside blocks, (c, u): each class's block of the first round).

    A class's home is its token with the largest group. Further rounds take the classes of groups of several
    blocks, one for each that a block has joined, as long as a quarter of them goes.
    """
    mapping = units = None
    current = postings
    while True:
        groups = current.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).filter("size > 1")
        home = current.join(groups, "token").groupBy("c").agg(F.max(F.struct("size", "token", "tokens")).alias("h"))
        salts = F.ceil(F.greatest(F.col("h.tokens") / F.lit(BLOCK_TOKENS), F.col("h.size") / F.lit(BLOCK_SETS)))
        members = home.select("c", F.col("h.token").alias("home"), F.pmod(F.xxhash64("c"), salts).alias("salt"), salts.alias("salts"))
        members = materialise(members, "ngram-members")
        step = materialise(_join_blocks(members.join(sets, "c"), percent).filter("c != m"), "ngram-merged")
        if mapping is None:
            mapping, units = step, members.select("c", F.struct("home", "salt").alias("u"))
        else:
            after = step.select(F.col("c").alias("m"), F.col("m").alias("m2"))
            mapping = materialise(mapping.join(after, "m", "left").select("c", F.coalesce("m2", "m").alias("m")).unionByName(step), "ngram-mapping")
        large = members.filter("salts > 1").select("c")
        n, left = large.count(), materialise(large.join(step.select("c"), "c", "left_anti"), "ngram-left")
        if not n or left.count() * 4 > n * 3:
            return mapping, units
        current = current.join(left, "c", "left_semi")


def _remaining_edges(postings: DataFrame, sets: DataFrame, mapping: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Verified edges (u, v) between joined groups, from pairs of blocks whose classes share enough prefix tokens.

    All pairs inside a block are verified before. Blocks meet as wholes: a group of many classes that are
    alike but not linked is a few pairs of blocks, not all its pairs of classes.
    """
    placed = units.join(mapping, "c", "left").withColumn("m", F.coalesce("m", "c"))
    t = postings.join(placed, "c").groupBy("token", "u").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("l").alias("l"), F.min("m").alias("low"), F.max("m").alias("high"))
    t = materialise(t, "ngram-groups")
    # a token whose classes are joined already, such as that of one large group of near copies, pairs no blocks
    apart = t.groupBy("token").agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).filter("lowest != highest").select("token")
    t = t.join(apart, "token")
    x, y = (t.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("u", "least", "most", "l", "low", "high")]) for s in "xy")
    fits = (F.col("most_x") * 100 >= F.col("least_y") * percent) & (F.col("most_y") * 100 >= F.col("least_x") * percent)
    joined = (F.col("low_x") == F.col("high_x")) & (F.col("low_y") == F.col("high_y")) & (F.col("low_x") == F.col("low_y"))
    pairs = x.join(y, (x.token == y.token) & (F.col("u_x") < F.col("u_y")) & fits & ~joined).groupBy("u_x", "u_y").agg(F.count("*").alias("shared"), F.min(F.least("l_x", "l_y")).alias("l"))
    pairs = materialise(pairs.filter("shared >= l").select("u_x", "u_y"), "ngram-pairs")
    asked = pairs.select(F.col("u_x").alias("u")).union(pairs.select(F.col("u_y").alias("u"))).distinct()
    whole = sets.join(placed, "c").join(asked, "u").groupBy("u").agg(F.collect_list(F.struct("m.a", "m.b", "set")).alias("members"))
    blocks = materialise(whole, "ngram-blocks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(cell: pa.ListScalar) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
            a, b, s = (cell.values.field(i) for i in range(3))
            return list(zip(a.to_pylist(), b.to_pylist())), [np.frombuffer(v.as_buffer(), "<u8") for v in s]

        for batch in batches:
            found: set[tuple[int, int, int, int]] = set()
            for k in range(batch.num_rows):
                (names_x, x), (names_y, y) = (side(batch.column(c)[k]) for c in (0, 1))
                for i, j in links(x, percent, y).tolist():
                    if names_x[i] != names_y[j]:
                        found.add((*names_x[i], *names_y[j]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["a", "b", "ma", "mb"])

    both = pairs.join(blocks.select(F.col("u").alias("u_x"), F.col("members").alias("x")), "u_x").join(blocks.select(F.col("u").alias("u_y"), F.col("members").alias("y")), "u_y")
    found = both.select("x", "y").mapInArrow(verify, "a long, b long, ma long, mb long")
    return found.select(_class().alias("u"), F.struct(F.col("ma").alias("a"), F.col("mb").alias("b")).alias("v"))


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80, postings_per_slice: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    counted = materialise(_count_pass(docs, words), "ngram-counts")
    rows = counted.filter("slice IS NULL").select("doc_id", "n", F.when(F.col("n") > 0, _class()).alias("c"))
    tokens_of = _token_counts(counted)
    classes = rows.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("low"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("k"))
    most = rows.agg(F.sum(F.least(F.col("n"), F.col("n") * (100 - percent) / 100 + MOST_MATCHES))).first()[0] or 0
    met = materialise(_shared_postings(docs, words, percent, tokens_of, -(-int(most) // postings_per_slice)), "ngram-postings")
    postings = materialise(_possible(met), "ngram-possible")
    release(met)
    wanted = classes.join(postings.select("c").distinct(), "c").select("k", "c")
    sets = materialise(_whole_sets(docs, wanted, words), "ngram-sets")
    mapping, units = _merge(postings, sets, percent)
    roots = connected_components(_remaining_edges(postings, sets, mapping, units, percent))
    release(postings, sets)
    joined = mapping.join(roots.withColumnRenamed("u", "m"), "m", "left").select("c", F.coalesce("root", "m").alias("g"))
    joined = joined.unionByName(roots.select(F.col("u").alias("c"), F.col("root").alias("g"))).distinct()
    named = classes.join(joined, "c", "left").select("c", "low", F.coalesce("g", "c").alias("g"))
    lowest = named.groupBy("g").agg(F.min("low").alias("component"))
    component = materialise(named.join(lowest, "g").select("c", "component"), "ngram-components")
    out = rows.join(component, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))

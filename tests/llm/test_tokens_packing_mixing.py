"""Token files, packing and mixing against brute force on small fixtures."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenrank.llm import mixing, packing, rans, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, length long"


def fixture(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1) for i, t, s in rows], SCHEMA)


def some_rows(n=120, seed=3):
    rng = random.Random(seed)
    words = ["The", "thón", "it's", "12", "a,", "<|endoftext|>", "x" * 90, "日本", "ÀÖ;", "!?", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 900]))), rng.choice(["a", "b", None, "c"])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "zero"), (5, rows[5][1], rows[5][2]), (None, "no id", "b")]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    alphabet = "ab cÉßİΣς'<|endoftext|> \n\t\r\x0b\x1c\x85  .,!%&é́a１2한日 ǅﬁ×÷Å'sS't"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [None, "", "DON'T we'll", "x" * 500 + "." * 200]
    full = Tokenizer.from_file(tokens.default_vocabulary())
    for cap in (2_000_000, 10):  # the second empties its table all the time
        got = {}
        for row, ids, cuts in tokens.CachedEncoder(tokens.default_vocabulary(), cap).encode_batch(pa.array(texts, pa.string()), 7):
            got |= {row + k: ids[cuts[k] : cuts[k + 1]].tolist() for k in range(len(cuts) - 1)}
        assert [got[k] for k in range(len(texts))] == [full.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def naive_best_fit(lengths, capacity):
    """Remaining capacities after placing pieces one by one, longest first, each in the tightest bin."""
    open_bins = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(open_bins, n)
        remaining = open_bins.pop(k) if k < len(open_bins) else capacity
        insort(open_bins, remaining - n)
    return open_bins


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_over_counts_is_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.choice([1, 50, 2000]))]
    runs = packing.best_fit_decreasing([(n, lengths.count(n)) for n in set(lengths)], capacity)
    used, seen = {}, {}
    for length, rank, n, first, each, at in runs:
        for j in range(n):
            seen.setdefault(length, []).append(rank + j)
            used.setdefault(first + j // each, []).append((at + j % each * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(lengths.count(k))) for k in set(lengths)}
    for pieces in used.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == naive_best_fit(lengths, capacity)


def test_packing(spark):
    rows = some_rows()
    got = packing.pack_documents(fixture(spark, rows), capacity=256).collect()
    full = Tokenizer.from_file(tokens.default_vocabulary())
    want = []
    for i, t, _ in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want.append((i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r[:5]) for r in got], key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a == sum(n for _, n in p[:k]) for k, (a, _) in enumerate(p)) and sum(n for _, n in p) <= 256
    assert len(places) == len(naive_best_fit([w[3] for w in want], 256))
    assert packing.pack_documents(fixture(spark, [])).count() == 0


def test_token_files(spark):
    rows = some_rows()
    manifest = rans.write_token_files(fixture(spark, rows), rans.token_folder(spark), tokens_per_file=3000)
    got = rans.read_token_files(spark, manifest).orderBy("start").collect()
    full = Tokenizer.from_file(tokens.default_vocabulary())
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(full.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
        at += len(ids)
    empty = rans.write_token_files(fixture(spark, []), rans.token_folder(spark))
    assert rans.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("kind", ["zipf", "flat", "one", "many"])
def test_rans_round_trip_random_access_and_checksums(kind):
    rng = np.random.default_rng(0)
    n = 300_001
    ids = {"zipf": rng.zipf(1.3, n) % 49_000, "flat": rng.integers(0, 49_409, n), "one": np.full(n, 7), "many": np.arange(n)}[kind].astype(np.uint32)
    lengths = np.array([1, 0, 100_000, n - 100_001])
    raw = rans.encode_file(ids, [3, None, 4, 5], lengths)
    file = rans.TokenFile(raw)
    assert np.array_equal(file.blocks(0, len(file.points)), ids)
    assert np.array_equal(file.blocks(2, 3), ids[2 * rans.BLOCK : 3 * rans.BLOCK])
    assert [(d, a, len(x)) for d, a, x in file.documents()] == [(3, 0, 1), (None, 1, 0), (4, 1, 100_000), (5, 100_001, n - 100_001)]
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.TokenFile(bytes(broken)).blocks(0, len(file.points))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share, stop what is above its limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, fixed, budget = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = budget - sum(target[s] for s in fixed)
        for s in free:
            target[s] = rest * w[s] / sum(w[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
        fixed |= set(over)


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rows = some_rows(seed=seed)
    got = mixing.mix_sources(fixture(spark, rows), carry=["text", "key"], rows_per_range=8).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in mine) == int(mine[0].target)
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)
    again = mixing.mix_sources(fixture(spark, rows[::-1])).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)
    mixed = mixing.mixed_documents(fixture(spark, rows))
    assert mixed.columns == fixture(spark, rows).columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_sources(fixture(spark, [])).count() == 0

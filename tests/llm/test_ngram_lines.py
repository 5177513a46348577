"""Jaccard components and line chunks against brute force."""

import random
import re

import numpy as np
import pytest

from lumenrank.llm import linededup, ngram, wordhash

SCHEMA = "doc_id long, text string, a string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(j) == find(i) and e is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def near_copies(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 30, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (7, rows[3][1]), (None, rows[5][1]), (n + 3, "é " * 50000), (n + 4, "é " * 50001)]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_components(spark, seed, k, percent):
    rows = near_copies(seed)
    got = ngram.jaccard_components(frame(spark, rows), words=k, percent=percent, postings_per_slice=500).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(rows, k, percent), key=repr)


def test_components_of_a_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", 300)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = ngram.jaccard_components(frame(spark, rows), words=3, percent=85).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 3, 85))


def test_no_rows(spark):
    assert ngram.jaccard_components(frame(spark, [])).count() == 0
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_prefixes_share_enough_tokens(seed):
    """The property that the join rests on, over random pairs and random counts."""
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(2000) < 0.5, 0, rng.integers(2, 500, 2000))
    for _ in range(200):
        percent = int(rng.choice([60, 80, 90]))
        x = np.sort(rng.choice(2000, int(rng.integers(1, 120)), replace=False)).astype(np.uint64)
        y = x[rng.random(len(x)) > 0.08]
        y = np.unique(np.concatenate([y, rng.choice(2000, int(rng.integers(0, 6))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        (px, lx), (py, ly) = (ngram.choose_prefix(v, counts[v.astype(int)], percent) for v in (x, y))
        assert len(np.intersect1d(px, py)) >= min(lx, ly)


def test_links_in_blocks_equal_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(300, rng.integers(1, 60))).astype("<u8") for _ in range(40)] + [np.arange(50, dtype="<u8"), np.arange(1, 51, dtype="<u8")]
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert [tuple(p) for p in ngram.links(sets, 60).tolist()] == want
    assert [tuple(p) for p in ngram.links(sets[:-1], 60, sets[-1:]).tolist()] == [(i, 0) for i, j in want if j == len(sets) - 1]


def test_graph_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = dict(map(tuple, ngram.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {x: got.get(x, x) for x in root} == root


def brute_chunks(text):
    """Chunks of a text, by the rules in words: a boundary ends a chunk of two lines or more, 16 lines at most."""
    lines = text.split("\n")
    raw = [line.encode() for line in lines]
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = np.cumsum([0] + [len(r) + 1 for r in raw])
    h = wordhash.hashes(data, cuts[:-1], cuts[:-1] + [len(r) for r in raw]) if len(data) else np.zeros(1, np.uint64)
    out, at = [], 0
    for i in range(len(lines)):
        rolled = h[i : i + 1] + (h[i - 1] * np.uint64(3) if i else np.uint64(0))
        ends = int(wordhash.mix(rolled)[0]) & 3 == 0
        if (ends and i + 1 - at >= 2) or i + 1 == len(lines) or i + 1 - at == linededup.MOST:
            out.append(lines[at : i + 1])
            at = i + 1
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 8))) for _ in range(60)]
    passage = [" ".join(f"p{i}{j}" for j in range(9)) for i in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            k = rng.randrange(len(lines))
            lines[k:k] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[4][1]), (101, ""), (102, "\n\n\n"), (103, None), (104, rows[4][1] + "\nlast")]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows), min_words=6).collect()}
    seen = set()
    for i, text in rows:
        if text is None:
            assert got[i].text is None
            continue
        kept, cut = [], 0
        for chunk in brute_chunks(text):
            key = "\n".join(chunk)
            if len(chunk) >= 2 and len(key.split()) >= 6:
                if key in seen:
                    cut += len(chunk)
                    continue
                seen.add(key)
            kept.append(key)
        assert (got[i].text, got[i].removed_lines) == ("\n".join(kept), cut), i
    assert got[100].text == "" or got[100].removed_lines > 0
    assert sum(passage[12] in r.text for r in got.values() if r.text) <= 3

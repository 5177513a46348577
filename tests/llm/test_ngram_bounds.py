"""Memory of a block of small sets, unfinished components, and both ways to settle edges."""

import random
import tracemalloc

import numpy as np
import pytest

from lumenrank.llm import ngram
from tests.llm.test_ngram_lines import brute_components, frame


@pytest.mark.parametrize("tokens", [1, 5, 10])
def test_a_full_block_of_small_sets_is_small(tokens):
    rng = np.random.default_rng(tokens)
    sets = [np.unique(rng.integers(0, 4000, tokens)).astype("<u8") for _ in range(ngram.BLOCK_SETS)]
    tracemalloc.start()
    ngram.links(sets, 80)
    ngram.links(sets, 80, sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_one_hot_token_in_many_small_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK_SETS", 16)
    rng = random.Random(2)
    rows = [(i, f"hot word here {rng.choice('abcdefgh')} {rng.choice('xyz')}") for i in range(300)]
    got = ngram.jaccard_components(frame(spark, rows), words=3, percent=50).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 3, 50))


def chain(n):
    return [(i, i + 1) for i in range(n)]


@pytest.mark.parametrize("small", [0, 10**6])
def test_both_ways_to_settle_edges(spark, small):
    rng = random.Random(small)
    edges = chain(50) + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = dict(map(tuple, ngram.connected_components(spark.createDataFrame(edges, "u long, v long"), small=small).collect()))
    assert got == {x: r for x, r in root.items() if x != r}
    pairs = spark.createDataFrame([((u, -u), (v, -v)) for u, v in edges], "u struct<a: long, b: long>, v struct<a: long, b: long>")
    got = {r.u.a: r.root.a for r in ngram.connected_components(pairs, small=small).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert ngram.connected_components(spark.createDataFrame([], "u long, v long"), small=small).count() == 0


def test_unsettled_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        ngram.connected_components(spark.createDataFrame(chain(200), "u long, v long"), most_rounds=1, small=0)

"""Repeated query rows of a search."""

import numpy as np
from pyspark.sql import functions as F

from lumenrank.llm import ann
from tests.llm.test_media_quality_license import vectors


def test_repeated_query_rows(spark):
    x = np.random.default_rng(0).normal(size=(300, 16)).astype(np.float32)
    other = -x[20]
    extra = [(0, [float(v) for v in x[0]], "l"), (20, [float(v) for v in other], "l")]
    got = ann.search(vectors(spark, x, extra), (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 41), k=20).collect()
    of = lambda q: [r for r in got if r.query_id == q]
    assert sorted(r["rank"] for r in of(0)) == list(range(1, 21)) and len({(r.vec_id, r.score) for r in of(0)}) == 20
    assert sorted(r["rank"] for r in of(20)) == sorted([*range(1, 21)] * 2) and len(of(40)) == 20


def test_rows_with_the_query_id_are_candidates(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [2.0, 1.0], [0.5, 0.0], [0.0, 3.0]]
    table = spark.createDataFrame([(i, v, "a") for i, v in zip((0, 0, 0, 1, 2), x)], "vec_id long, embedding array<double>, query string")
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20).collect()
    of = {}
    for r in got:
        of.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(of) == {0} and sorted(of[0]) == sorted([(1, 0, 2.0), (2, 0, 1.0), (3, 1, 0.5), (4, 2, 0.0), (1, 2, 3.0), (2, 0, 2.0), (3, 0, 2.0), (4, 1, 1.0)])


def test_blocks_of_any_size_give_good_neighbours(spark):
    x = np.random.default_rng(1).normal(size=(4000, 16)).astype(np.float32)
    got = ann.search(vectors(spark, x), F.col("vec_id") % 200 == 0, k=10, block_bytes=16 * 4 * 500).collect()
    best = {q: set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:10].tolist()) for q in range(0, 4000, 200)}
    assert len(got) == 200 and sum(r.vec_id in best[r.query_id] for r in got) >= 190

"""Empty tables, repeated rows, clashing names, and plain-Python forms of the quality statistics."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lumenrank.llm import mixing, quality, wordhash
from lumenrank.llm.common import shared_dir

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, taken string, target string, _range string, row string, _gone string, `a.b` string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "s", "k", "t", "g", "r", "w", "o", "d") for i, t, s in rows], CLASHING)


def test_the_mix_keeps_every_column(spark):
    rows = [(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)] + [(1, None, None), (1, "", "a"), (2, "w2 " * 3, "a")]
    docs = clashing(spark, rows)
    got = mixing.mixed_documents(docs).collect()
    assert got and all(r["size"] == "s" and r["key"] == "k" and r["_range"] == "r" and r["a.b"] == "d" and r["row"] == "w" and r["target"] == "g" for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    carried = mixing.mix_sources(docs, carry=["_range", "a.b", "n_chars"]).collect()
    assert len(carried) == len(rows) and {(r["_range"], r["a.b"]) for r in carried} == {("r", "d")}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=lambda s: s.__name__)
def test_stages_on_odd_tables(spark, tmp_path, stage):
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(0, "some words here", "a"), (0, "some words here", "a"), (None, None, None), (1, "", "b"), (2, "x " * 9000, "b"), (None, "y\n" * 40, None)]
    docs = clashing(spark, rows)
    got = stage(spark, docs, str(tmp_path)).collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage is not corpus_pipeline.pack_sequences:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and all(r["a.b"] == "d" and r["_gone"] == "o" for r in got)
    without = docs.drop("n_chars")
    assert stage(spark, without, str(tmp_path)).count() == len(got)


def plain_statistics(text):
    raw, lower = text.encode(), re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    folded = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    lines = [x for x in text.split("\n") if x]
    n, pairs = len(words), list(zip(folded, folded[1:]))
    steady = lambda count, of, k: (count + 0.01 * k) / (of + k)
    squash = lambda r: math.log(r + 0.002)
    symbols = b"#$%&*+/<=>@[\\]^_{}~"
    share = lambda members: squash(steady(sum(b in members for b in raw), len(raw), 150))
    return {
        "words": math.log1p(n), "word_bytes": math.log((sum(len(w.encode()) for w in words) + 100) / (n + 20)), "symbols": share(symbols), "pipes": share(b"|"),
        "upper": share(bytes(range(65, 91))), "digits": share(b"0123456789"), "stops": share(b".,;:?"), "exclamations": share(b"!"), "non_ascii": share(bytes(range(128, 256))),
        "short_words": steady(sum(len(w.encode()) <= 3 for w in words), n, 20), "symbol_ends": squash(steady(sum(w.encode()[-1] in symbols for w in words), n, 20)),
        "distinct_words": (len(set(folded)) / max(n, 1) - 1) * math.log1p(n), "distinct_pairs": squash(steady(len(pairs) - len(set(pairs)), len(pairs), 60)),
        "lines": math.log1p(len(lines)), "line_words": math.log1p(n / max(len(lines), 1)), "repeated_lines": squash(steady(len(lines) - len(set(lines)), len(lines), 10)),
    }


def test_quality_statistics_equal_plain_ones():
    texts = ["", "One two TWO.\nOne two!\nOne two TWO.", " \n\t ", "é€ #a b# 1|2 the the the the", "x" * 3000 + " y\n" * 20, "A"]
    got = quality.statistics(*wordhash.buffers(pa.array(texts)))
    want = [[plain_statistics(t)[k] for k in quality.STATISTICS] for t in texts]
    assert np.allclose(got, want)


def test_regularised_factors():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(50, 4)), rng.normal(size=(90, 4)) * [1, 2, 3, 0.1] + 1]
    m = quality.QuadraticDiscriminant.fit(np.array([50.0, 90.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), pooled=0.2, diagonal=0.3, ridge=0.05)
    cov = [np.cov(v.T, bias=True) for v in x]
    both = (50 * cov[0] + 90 * cov[1]) / 140
    z, dens = rng.normal(size=(9, 4)), []
    for c in range(2):
        s = 0.5 * cov[c] + 0.2 * both + 0.3 * np.diag(np.diag(cov[c])) + 0.05 * np.eye(4)
        d = z - x[c].mean(0)
        dens.append([50, 90][c] * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / np.sqrt(np.linalg.det(s)))
    assert np.allclose(m.score(z), dens[1] / (dens[0] + dens[1]))


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else None)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)

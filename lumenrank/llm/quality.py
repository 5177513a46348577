"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the raw bytes, words and lines of each whole text (never labels, language, source or
id) are transformed towards normal shape. Each class keeps its mean and a covariance shrunk towards
the pooled one and its own diagonal; a score is the logistic of the difference of the classes'
Mahalanobis log-densities, with the Cholesky factors computed once.

Defined results: a null or empty text has all-zero counts and is scored like any other; labels that
are null or neither 0 nor 1 teach nothing; a document with several labels teaches each of them; with
one class or none to learn from, every score is that class's share, or 0.5; an empty table gives an
empty result; columns with the names of the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm import wordhash
from lumenrank.llm.common import materialise

STATISTICS = (
    "words", "word_bytes", "symbols", "pipes", "upper", "digits", "stops", "exclamations", "non_ascii",
    "short_words", "symbol_ends", "distinct_words", "distinct_pairs", "lines", "line_words", "repeated_lines",
)
FEATURES = "array<double>"


def _members(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOL = _members(b"#$%&*+/<=>@[\\]^_{}~")
_KINDS = {
    "symbols": _SYMBOL, "pipes": _members(b"|"), "upper": _members(bytes(range(65, 91))), "digits": _members(b"0123456789"),
    "stops": _members(b".,;:?"), "exclamations": _members(b"!"), "non_ascii": _members(bytes(range(128, 256))),
}
_NEWLINE = np.ones(256, bool)
_NEWLINE[:] = False
_NEWLINE[0x0A] = True


def _distinct(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Distinct values in each run between cuts."""
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(cuts) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of a run of texts: [texts, len(STATISTICS)]."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, cuts = wordhash.spans(data, offsets, wordhash.ASCII_SPACE)
    words = np.diff(cuts).astype(float)
    out: dict[str, np.ndarray] = {}

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    rate = lambda count, of: count / np.maximum(of, 1)
    steady = lambda count, of, k: (count + 0.01 * k) / (of + k)  # noqa: E731  short texts stay near 1 %
    squash = lambda r: np.log(r + 0.002)
    for name, members in _KINDS.items():
        out[name] = squash(steady(per_text(members[data], offsets), size, 150))
    length = ends - starts
    out["words"] = np.log1p(words)
    out["word_bytes"] = np.log((per_text(length, cuts) + 100) / (words + 20))
    out["short_words"] = steady(per_text(length <= 3, cuts), words, 20)
    out["symbol_ends"] = squash(steady(per_text(_SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool), cuts), words, 20))
    h = wordhash.hashes(data, starts, ends, fold=True) if len(data) else np.zeros(0, np.uint64)
    out["distinct_words"] = (rate(_distinct(h, cuts), words) - 1) * np.log1p(words)
    pairs = wordhash.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    inner = np.ones(len(pairs), bool)
    edge = cuts[1:-1] - 1  # a pair does not cross texts
    inner[edge[(edge >= 0) & (edge < len(pairs))]] = False
    pair_cuts = np.concatenate([[0], np.cumsum(inner)])[np.clip(cuts, 0, len(pairs))]
    pairs = pairs[inner]
    pair_cuts[-1] = len(pairs)
    n_pairs = np.diff(pair_cuts).astype(float)
    out["distinct_pairs"] = squash(steady(n_pairs - _distinct(pairs, pair_cuts), n_pairs, 60))
    ls, le, lcuts = wordhash.spans(data, offsets, _NEWLINE)
    lines = np.diff(lcuts).astype(float)
    out["lines"] = np.log1p(lines)
    out["line_words"] = np.log1p(rate(words, lines))
    lh = wordhash.hashes(data, ls, le) if len(data) else np.zeros(0, np.uint64)
    out["repeated_lines"] = squash(steady(lines - _distinct(lh, lcuts), lines, 10))
    return np.stack([out[k] for k in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    alone: float | None = None  # the score of everything if a class is missing

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, *, pooled: float = 0.1, diagonal: float = 0.05, ridge: float = 0.02) -> QuadraticDiscriminant:
        """From each class's count, sum and sum of outer products."""
        d = sums.shape[1]
        if (n < 2).any():
            total = n.sum()
            return cls(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float(n[1] / total) if total else 0.5)
        means = sums / n[:, None]
        cov = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
        both = (cov * n[:, None, None]).sum(0) / n.sum()
        factors, constants = [], []
        for c in range(2):
            s = (1 - pooled - diagonal) * cov[c] + pooled * both + diagonal * np.diag(np.diag(cov[c])) + ridge * np.eye(d)
            chol = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(chol))
            constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum())
        return cls(means, np.array(factors), np.array(constants))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.alone is not None:
            return np.full(len(x), self.alone)
        log_density = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in range(2)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and features (transformed statistics) of every whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in wordhash.blocks(batch.column(1)):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), lists], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, f"doc_id long, features {FEATURES}")


def learns(doc_id) -> F.Column:
    """Rows whose labels may be learned from: crc32 of the id as text is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(features: DataFrame, labels: DataFrame) -> QuadraticDiscriminant:
    """All labelled rows that may be learned from; only class sums reach the driver."""
    d = len(STATISTICS)
    known = labels.filter(F.col("quality").isin(0, 1) & learns(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in range(2):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        k = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total.ravel())], ["k", "v"])

    joined = features.join(known, "doc_id").select("y", "features")
    got = np.zeros(2 * (1 + d + d * d))
    for r in joined.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r.k] = r.v
    got = got.reshape(2, -1)
    return QuadraticDiscriminant.fit(got[:, 0], got[:, 1 : d + 1], got[:, d + 1 :].reshape(2, d, d))


def score(features: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """doc_id and score of each row of ``features``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(x), 9))], ["doc_id", "score"])

    return features.select("doc_id", "features").mapInArrow(compute, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    features = materialise(document_statistics(docs), "quality-features")
    scored = score(features, fit(features, labels))
    held_out = F.coalesce(~learns(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Scores come from each row's own text (null: empty), so no join by id is needed to filter, and only texts
    and verdicts pass between Spark and Python. Repeated rows stay or go together.
    """
    model = fit(materialise(document_statistics(docs), "quality-features"), labels)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        scores = [model.score(statistics(data, offsets)) for _, data, offsets in wordhash.blocks(texts)]
        return pa.array(np.round(np.concatenate([np.zeros(0), *scores]), 9) >= threshold)

    return docs.filter(accepted("text"))

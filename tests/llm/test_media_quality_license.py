"""Audio payloads, the quality discriminant, license scans, vector search and unigram counts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import ann, license, media, quality, queries, unigram, wordhash

SCHEMA = "doc_id long, text string, payload string, score string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)


TEXTS = [(0, "Hello world"), (1, None), (2, ""), (3, "x" * 576), (4, "é" * 3000), (None, "no id"), (0, "Hello world"), (9, "low " * 2000 + "HIGH~~~" * 3000 + "low " * 2000)]


def test_audio_table(spark):
    rows = media.audio_features(media.media_table(docs(spark, TEXTS))).collect()
    assert len(rows) == len(TEXTS)
    by_size = {}
    for r in rows:
        by_size.setdefault((r.doc_id, r.n_bytes), []).append(r)
    for i, t in TEXTS:
        raw = (t or "").encode()
        r = by_size[(i, len(raw))][0]
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert r.payload == want and media.decode_wave(r.media) == (media.RATE_IN, want)
        frames, patches = media.features(want)
        assert (r.n_frames, len(r.segments)) == (frames, len(patches))
        for s, p in zip(r.segments, patches):
            assert s.tensor == pytest.approx(p[3].ravel().tolist()) and s.start_ms == p[0] < s.end_ms
    assert any(r.segments for r in rows)
    tensors = media.fixed_shape_tensors(pa.array(np.arange(2 * media.PATCH * media.MELS, dtype=np.float32)))
    assert tensors.type == pa.fixed_shape_tensor(pa.float32(), [media.PATCH, media.MELS]) and len(tensors) == 2
    assert media.audio_features(media.media_table(docs(spark, []))).count() == 0


def test_audio_contract(spark, tmp_path):
    docs(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op1_audio_features(spark, str(tmp_path)).collect():
        raw = next((t or "").encode() for i, t in TEXTS if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        want = raw + b"\xff" * (r.payload_bytes - len(raw))
        assert r.payload_bytes % 576 == 0 and r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        wave = media.encode_wave(want)
        assert (r.media_bytes, r.media_sha256) == (len(wave), hashlib.sha256(wave).hexdigest())


def test_polyphase_equals_filtering_the_stuffed_signal():
    x = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    h = media._phases()[:, ::-1].T.reshape(-1)
    stuffed = np.zeros(len(x) * media.UP)
    stuffed[:: media.UP] = x
    full = np.convolve(stuffed, h)
    y = media.resample(x)
    assert len(y) == -(-len(x) * media.UP // media.DOWN)
    delay = media.UP * (media.TAPS // 2 - 1)
    assert np.allclose(full[delay :: media.DOWN][: len(y)], y, atol=1e-5)
    tone = np.sin(2 * np.pi * 440 * np.arange(media.RATE_IN) / media.RATE_IN).astype(np.float32)
    y = media.resample(tone)
    assert abs(np.abs(np.fft.rfft(y)).argmax() - 440) <= 1 and y[500:-500].std() * 2**0.5 == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("seed", range(5))
def test_hysteresis_equals_a_state_machine(seed):
    e = np.random.default_rng(seed).normal(size=200).cumsum().astype(np.float32)
    on, want, start = False, [], 0
    for i, v in enumerate(e):
        if not on and v >= np.median(e) + media.ON_DB:
            on, start = True, i
        elif on and v < np.median(e) + media.OFF_DB:
            on = False
            want.append((start, i))
    assert media.segments(e) == want + ([(start, len(e))] if on else [])


def test_quality_statistics_stay_with_their_text():
    texts = ["One two two.\nOne", "", "A | b | c ### $$$ 12", "é" * 9, " \n "]
    alone = [quality.statistics(*wordhash.buffers(pa.array([t]))) for t in texts]
    assert np.allclose(np.concatenate(alone), quality.statistics(*wordhash.buffers(pa.array(texts))))


def test_quality_holds_out_and_separates(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = [word() for _ in range(rng.randint(3, 120))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x + rng.choice(["###", "%%%"]) for x in w)))
        labels.append((i, int(good), 0))
    labels += [(3, None, 0), (10_000, 1, 0), (None, 0, 0), (4, 7, 0)]
    rows += [(600, None), (601, ""), (None, "a b"), (5, rows[5][1])]
    got = quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    truth = {i: q for i, q, _ in labels[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = quality.keep_documents(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == ["doc_id", "text", "payload", "score"] and kept.count() == sum(r.predicted for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs(spark, rows[:5]), none).collect()} == {0.5}


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(300, 3)), rng.normal(size=(700, 3)) @ np.diag([1, 2, 3]) + 1]
    m = quality.QuadraticDiscriminant.fit(np.array([300.0, 700.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), pooled=0.0, diagonal=0.0, ridge=0.0)
    z = rng.normal(size=(20, 3))
    dens = []
    for c in range(2):
        cov, d = np.cov(x[c].T, bias=True), z - x[c].mean(0)
        dens.append([0.3, 0.7][c] * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)) / np.sqrt(np.linalg.det(cov)))
    assert np.allclose(m.score(z), dens[1] / (dens[0] + dens[1]))


def test_license_scan_equals_all_blocks_against_all_templates(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in license.TEMPLATES for w in license.words(t)}) + ["foo", "bar"] * 40
    rows = [(0, "CC-BY cc by, cc. by"), (1, None), (2, ""), (3, "All rights\nreserved General Public License"), (4, "cc cc by by all rights all rights reserved"), (None, "Released under the MIT License.")]
    for i in range(5, 60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            t = license.words(rng.choice(license.TEMPLATES)[1])
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x for x in t if rng.random() > 0.15]
        rows.append((i, rng.choice([" ", "\n"]).join(w).upper()))
    rows += [(4, rows[4][1])]
    got = license.scan(docs(spark, rows)).collect()
    import re

    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s))
    want = []
    for i, t in rows:
        w, places, base, found, most = words(t or ""), [], set(), set(), 0.0
        for phrase, label in license.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        for label, template in license.TEMPLATES:
            ts, size = set(words(template)), next(64 << k for k in range(9) if 64 << k >= 2 * len(words(template)))
            for s in range(0, max(len(w) - size // 2, 1), size // 2):
                block = set(w[s : s + size])
                if len(ts & block):
                    if 100 * len(ts & block) >= license.CONTAINMENT_PERCENT * len(ts):
                        found.add(label)
                        most = max(most, round(len(ts & block) / len(ts), 6))
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), max(most, float(bool(places)))))
    assert sorted([tuple(r)[:8] for r in got], key=repr) == sorted(want, key=repr)
    assert license.scan(docs(spark, [])).count() == 0


def vectors(spark, x, extra=()):
    return spark.createDataFrame([*((i, [float(v) for v in row], "l") for i, row in enumerate(x)), *extra], "vec_id long, embedding array<float>, score string")


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:160] = x[100]  # ties
    bad = [(5000, None, "l"), (5020, [0.0] * 32, "l"), (5040, [float("nan")] * 32, "l"), (5060, [None] * 32, "l"), (5080, [1.0] * 5, "l"), (None, [1.0] * 32, "l")]
    got = ann.search(vectors(spark, x, bad), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, rows in by.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(s)), -s))[:20]
        hit += len(set(order.tolist()) & {r.vec_id for r in rows})
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id], abs=1e-9) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert hit / (20 * len(by)) >= 0.9
    assert [r.vec_id for r in by[100]][:20] == list(range(101, 121))


def test_search_of_few_vectors(spark):
    got = ann.search(vectors(spark, np.eye(4, dtype=np.float32)), F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]
    assert ann.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0


def test_anisotropic_codes_lower_the_parallel_error():
    x = np.random.default_rng(3).normal(size=(2000, 16)).astype(np.float32)
    errors = []
    for threshold in (0.0, 0.4):
        book = ann.AnisotropicCodebook.fit(x, threshold=threshold)
        codes = book.encode(x)
        back = np.concatenate([book.centroids[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)[:, :16]
        errors.append((((x - back) * x).sum(1) / np.linalg.norm(x, axis=1)).std())
    assert errors[1] < 0.8 * errors[0]
    table, packed = book.tables(x[:3]), ann.pack_codes(codes)
    assert np.allclose(ann.scan(packed, table[1]), back @ x[1], atol=1e-3)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_counts_equal_the_tokenizer(byte_fallback):
    rng = random.Random(1)
    big = unigram.vocabulary_from_pieces(unigram.default_pieces())
    tied = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0)]
    for vocabulary, alphabet in ((big, "ab cÉß<0x41>▁▁ \n\t  .,!é日本語🙂😀the in on "), (tied, "ab  ▁cé")):
        counter, t = unigram.UnigramCounter(vocabulary, byte_fallback, max_words=50), unigram.tokenizer(vocabulary, byte_fallback)
        for text in ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "a" * 3000]:
            assert counter.text(text)[1] == len(t.encode(text, add_special_tokens=False).ids), text


def test_unigram_table(spark):
    got = unigram.count_tokens(docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) and {tuple(r) for r in got if r.doc_id in (1, 2)} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    assert unigram.count_tokens(docs(spark, [])).count() == 0

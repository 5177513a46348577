"""Every frame's log-mel is kept, segments or not."""

import numpy as np

from lumenrank.llm import media, queries
from tests.llm.test_media_quality_license import TEXTS, docs

EVEN = [(20, "abcdefgh" * 72), (21, "aazzmmkk" * 72)]  # of one length and even energy: no segment


def test_patches_hold_every_frame(spark):
    for r in media.audio_features(media.media_table(docs(spark, TEXTS + EVEN))).collect():
        mel, energy = media.log_mel(media.resample((np.frombuffer(bytes(r.payload), np.uint8).astype(np.float32) - 128) / 128))
        got = np.array([p.tensor for p in r.patches], np.float32).reshape(-1, media.MELS)
        assert r.n_frames == len(mel) and len(r.patches) == -(-len(mel) // media.PATCH)
        assert np.array_equal(got[: len(mel)], mel) and (got[len(mel) :] == -60).all()
        ms = 1000 * media.HOP / media.RATE_OUT
        assert [p.start_ms for p in r.patches] == [k * media.PATCH * ms for k in range(len(r.patches))]
        marked = [(k, min(b, k + media.PATCH)) for a, b in media.segments(energy) for k in range(a, b, media.PATCH)]
        assert [s.start_ms for s in r.segments] == [a * ms for a, _ in marked]
        if r.doc_id in (20, 21):
            assert not r.segments and r.patches


def test_texts_without_segments_differ(spark, tmp_path):
    docs(spark, EVEN).write.parquet(str(tmp_path / "documents.parquet"))
    assert len({r.feature for r in queries.op1_audio_features(spark, str(tmp_path)).collect()}) == 2

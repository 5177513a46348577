"""Stored tensors and token files: what is read back is what was written, whatever the number of tasks and files."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenrank.llm import media, rans
from lumenrank.llm.common import scratch_folder
from tests.llm.test_media_quality_license import TEXTS, docs
from tests.llm.test_tokens_packing_mixing import fixture, some_rows


def test_tensors_of_a_fixed_shape(spark, tmp_path):
    computed = media.audio_features(media.media_table(docs(spark, [*TEXTS, (21, "aazzmmkk" * 72)]))).select("doc_id", "n_frames", "patches", "segments")
    manifest = media.write_features(computed, str(tmp_path))
    back = media.read_features(spark, manifest, computed.schema)
    key = lambda r: (r.doc_id or -1, r.n_frames, str(r.patches))
    assert sorted(back.collect(), key=key) == sorted(computed.collect(), key=key)
    for r in manifest.collect():
        with pa.OSFile(r.file) as f:
            table = pa.ipc.open_file(f).read_all()
        assert table.num_rows == r.n_rows
        for name in ("patches", "segments"):
            kind = table.schema.field(name).type.value_type.field("tensor").type
            assert kind == pa.fixed_shape_tensor(pa.float32(), [media.PATCH, media.MELS])
    assert media.read_features(spark, media.write_features(computed.limit(0), str(tmp_path)), computed.schema).count() == 0


def test_files_in_bounded_tasks(spark):
    rows = [(i, t, s) for i, t, s in some_rows() if i is not None]
    folder = rans.token_folder(spark)
    manifest = rans.write_token_files(fixture(spark, rows).repartition(3), folder, tokens_per_file=300)
    assert rans.read_token_files(spark, manifest).rdd.getNumPartitions() == min(manifest.count(), 64)
    got = rans.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted(i for i, _, _ in rows) and len(glob.glob(f"{folder}/*.rans")) == manifest.count()
    assert manifest.select(F.sum("n_docs")).first()[0] == len(rows) and scratch_folder(spark, "x") != scratch_folder(spark, "x")

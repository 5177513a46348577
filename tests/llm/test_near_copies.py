"""The pipeline's near-copy stage keeps one row of each component, whatever the ids."""

import corpus_pipeline
from tests.llm.test_pipeline import SCHEMA


def test_one_row_of_each_component_stays(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [
        (1, text("a")), (None, text("a")),  # a copy without an id
        (None, text("b")),  # unique, without an id
        (None, text("c")), (None, text("c")), (None, text("c") + " end"),  # copies among rows without ids
        (5, text("d")), (7, text("d") + " end"), (7, text("e")),  # one id, two texts; one of them a near copy
        (9, text("f")), (9, text("f")),  # one row twice
        (10, ""), (11, None), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    got = corpus_pipeline.remove_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    named = [(i, t) for i, t in kept if t and t.split()[0] != "c0"]
    assert sorted(named, key=repr) == sorted([(1, text("a")), (None, text("b")), (5, text("d")), (7, text("e")), (9, text("f"))], key=repr)
    assert [i for i, t in kept if t and t.split()[0] == "c0"] == [None]
    assert sorted(((i, t) for i, t in kept if not t), key=repr) == sorted([(10, ""), (11, None), (None, ""), (None, None)], key=repr)
    assert corpus_pipeline.remove_near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0

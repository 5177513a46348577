"""The pipeline's stages over a small corpus, each against its own rule."""

import random

import corpus_pipeline
from lumenrank.llm import packing
from tests.llm.test_ngram_lines import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(12))
    rows, labels = [], []
    for i in range(160):
        good = rng.random() < 0.8
        lines = [" ".join(word() + ("" if good else rng.choice(["###", "%%%"])) for _ in range(rng.randint(4, 15))) for _ in range(rng.randint(1, 12))]
        text = "\n".join(lines) + ("." if good else "")
        if good and i % 9 == 0:
            text += "\n" + passage
        rows.append((i, text, "en", rng.choice(["a", "b", None])))
        labels.append((i, int(good), 0))
    for i in range(160, 180):  # near copies of one-line documents
        w = rows[0][1].replace("\n", " ").split()[:40]
        rows.append((i, " ".join([*w, word()] if i % 2 else w), "en", "c"))
    rows += [(180, None, "en", "a"), (181, "", None, "b")]
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict((r[0], r[1]) for r in rows), dict((i, q) for i, q, _ in labels)


def test_stages(spark, tmp_path):
    texts, quality = corpus(spark, str(tmp_path))
    docs, tables = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
    kept, lines, single, mixed, packed = tables
    assert all(t.columns == ["doc_id", "text", "lang", "source", "n_chars"] for t in tables[:4])
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, q in quality.items() if q} <= ids and sum(q == 0 for i, q in quality.items() if i in ids) <= 2
    after = {r.doc_id: r.text for r in lines.collect()}
    assert set(after) == ids and sum((r.n_chars or 0) != len(r.text or "") for r in lines.collect()) == 0
    assert sum(len(after[i] or "") for i in ids) < sum(len(texts[i] or "") for i in ids)
    components = brute_components(sorted(after.items()), 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in components if d == c)
    source = {r.doc_id: r.source for r in single.collect()}
    words = lambda t: len((t or "").split())
    total = sum(words(r.text) for r in single.collect())
    assert abs(sum(words(r.text) for r in mixed.collect()) - 1.5 * total) <= len(set(source.values()))
    assert packed.count() == packing.token_pieces(mixed).count()
    ends = {}
    for r in packed.collect():
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in ends.values())


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and len(corpus_pipeline.STAGES) == 5
